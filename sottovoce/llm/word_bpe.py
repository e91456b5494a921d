"""Encoding and decoding by merges, with an index of the places of every pair.

Texts are cut at ASCII blanks; no pre-token crosses them. The chunks of a block that a task has not met become words
(normalised and pre-tokenised as the vocabulary file says), and all distinct words of the block are encoded at once:
an index lists for the rank of each pair all its places in the block, ranks are taken in ascending order, all places
of a rank are merged from left to right, and the lists of the pairs that a merge makes are extended. Where a merge
makes a pair of a lower rank than its own, that rank comes first and the rest of the list waits, which is the
library's order within each word. Only a merge whose id has such pairs at all is made place by place. No pass over a word is repeated, so very long words cost no more than short ones.

Chunks of Latin letters, digits and signs are cut by a pattern; any other chunk goes through the file's own normaliser
and pre-tokeniser, once for each distinct chunk of a block. Special tokens in a text are found before that. The file has no
decoder, so a decoded text is its tokens joined by blanks.

A task remembers REMEMBERED bytes of chunks that a block held more than once, none above LONGEST bytes. Blocks hold
at most BLOCK bytes of text, or one text; words are indexed INDEXED bytes, or one word, at a time.

Edge cases: null and empty texts, and texts of blanks, have no tokens and decode to the empty text; texts and words of
any length are encoded whole; repeated rows give repeated results; null ids are carried; an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, blocks_of, scratch, table
from .packing import _byte_of

#: Bytes of chunks and of their results that a task remembers, and the longest chunk among them.
REMEMBERED, LONGEST = 48 << 20, 100
BLOCK, INDEXED = 4 << 20, 1 << 20
#: Bytes that an entry takes besides its contents, roughly.
ENTRY = 250
WORD_END = "</w>"


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PairIndex:
    """Encodes many words at once; ``encode`` gives the ids of all words in a row and where each word's ids begin."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        signs = [s for _, s in sorted((b, s) for s, b in _byte_of().items())]
        #: Ids of each byte inside a word (0-255) and at its end (256-511).
        self.first = np.array([vocab[s] for s in signs] + [vocab[s + WORD_END] for s in signs], dtype=np.int64)
        self.parts = [(vocab[a], vocab[b]) for a, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        left, right = np.array(self.parts, dtype=np.int64).reshape(-1, 2).T
        keys = left << 32 | right
        self.rank_at = np.argsort(keys)
        self.keys = keys[self.rank_at]
        # The lowest rank that each id takes part in; a merge whose id has a lower one than its own is made place by place.
        lowest = np.full(max(vocab.values()) + 1, len(keys), dtype=np.int64)
        np.minimum.at(lowest, left, np.arange(len(keys)))
        np.minimum.at(lowest, right, np.arange(len(keys)))
        self.one_by_one = (lowest[self.made] < np.arange(len(keys))).tolist()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_at[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        ends = np.cumsum([len(w) for w in words])
        codes = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        codes[ends - 1] += 256
        n = len(codes)
        # A place after the last one stands for the neighbour of a word's end; its id is in no pair.
        ids, after, before = np.append(self.first[codes], -1), np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends] = n
        before[0] = n
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def listed(left: np.ndarray, right: np.ndarray) -> int:
            """Lists the places ``left`` under the ranks of their pairs; the lowest of these."""
            found = self.ranks(ids[left], ids[right])
            has = found >= 0
            left, found = left[has], found[has]
            if not len(left):
                return len(self.keys)
            order = np.argsort(found, kind="stable")
            left, found = left[order], found[order]
            edges = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(left)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                r = int(found[low])
                if r not in where:
                    where[r] = []
                    heappush(active, r)
                where[r].append(left[low:high])
            return int(found[0])

        def merge(at: np.ndarray, new: int) -> int:
            gone = after[at]
            right, left = after[gone], before[at]
            ids[at], ids[gone] = new, -1
            after[at] = right
            before[right] = at
            return min(listed(at, right), listed(left, at))

        listed(np.arange(n), after[:n])
        while active:
            r = heappop(active)
            (a, b), new, lists = self.parts[r], self.made[r], where.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[(ids[at] == a) & (ids[after[at]] == b)]  # else a merge of a lower rank took one of the two
            if self.one_by_one[r]:
                for k, i in enumerate(at):
                    if ids[i] == a and ids[after[i]] == b and merge(at[k : k + 1], new) < r:
                        where[r] = [at[k + 1 :]]
                        heappush(active, r)
                        break
                continue
            if a == b and len(at):
                # In a stretch of equal ids every second place is merged.
                fresh = np.append(True, after[at[:-1]] != at[1:])
                begins = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - begins[np.cumsum(fresh) - 1]) % 2 == 0]
            if len(at):
                merge(at, new)
        stays = ids[:n] >= 0
        return ids[:n][stays], np.concatenate([[0], np.cumsum(stays)[ends - 1]])


def latin_words() -> tuple[re.Pattern, re.Pattern]:
    """(chunks that need no library, words of their lower case): letters, numbers and signs up to U+024F, which no normal form changes."""
    rest = [chr(i) for i in range(33, 0x250) if i not in (0x85, 0xA0, 0x130)]
    kind = {k: "".join(re.escape(c) for c in rest if unicodedata.category(c)[0] == k) for k in "LN"}
    return re.compile(f"[{re.escape(''.join(rest))}]*"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kind['L']}]+|[{kind['N']}]|[^{kind['L']}{kind['N']}]+")


class TextCoder:
    """Chunk to (the bytes of its ids, its tokens each after a blank)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        self.index = PairIndex(whole["model"]["vocab"], merges)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else re.compile("(?!)")
        self.tokens = np.empty(self.library.get_vocab_size(), dtype=object)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = f" {token}"
        self.byte_of = _byte_of()
        self.plain, self.word = latin_words()
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.bytes = 0

    def words(self, piece: str) -> list[bytes]:
        if self.plain.fullmatch(piece):
            return [w.encode() for w in self.word.findall(piece.lower())]
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes(map(self.byte_of.__getitem__, signs)) for signs, _ in cut]

    def learn(self, chunks: list[bytes]) -> dict[bytes, tuple[bytes, str]]:
        """Results of distinct chunks, whose distinct words are encoded together."""
        if not chunks:
            return {}
        # A word's number, or the negated id of a special token less one.
        number: dict[bytes, int] = {}
        made, counts = [], []
        for chunk in chunks:
            n = len(made)
            for part in filter(None, self.at_special.split(chunk.decode())):
                if part in self.special:
                    made.append(~self.special[part])
                else:
                    made += [number.setdefault(w, len(number)) for w in self.words(part)]
            counts.append(len(made) - n)
        ids, starts = self._all(list(number))
        # The special tokens stand as words of one id after the others.
        specials = sorted(self.special.values())
        ids, starts = np.concatenate([ids, specials]), np.concatenate([starts, starts[-1] + 1 + np.arange(len(specials))])
        w = np.array(made, dtype=np.int64)
        if len(specials):
            w = np.where(w >= 0, w, len(number) + np.searchsorted(specials, ~np.minimum(w, -1)))
        lengths = (starts[1:] - starts[:-1])[w]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        every = ids[np.repeat(starts[w] - sums[:-1], lengths) + np.arange(sums[-1])]
        edges = sums[np.concatenate([[0], np.cumsum(counts)])].tolist()
        data, tokens = every.astype("<u4").tobytes(), self.tokens[every].tolist()
        return {c: (data[4 * a : 4 * b], "".join(tokens[a:b])) for c, a, b in zip(chunks, edges[:-1], edges[1:], strict=True)}

    def _all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, here, size = [], [], 0
        for w in words:
            if here and size + len(w) > INDEXED:
                parts.append(self.index.encode(here))
                here, size = [], 0
            here.append(w)
            size += len(w)
        parts.append(self.index.encode(here))
        shifts = np.cumsum([0, *(len(i) for i, _ in parts)])
        return np.concatenate([i for i, _ in parts]), np.concatenate([[0], *(s[1:] + x for (_, s), x in zip(parts, shifts, strict=False))])

    def block(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of each text."""
        cut = [(t or "").encode().split() for t in texts]
        known, new = self.known, {}
        for chunks in cut:
            for c in chunks:
                if c not in known:
                    new[c] = new.get(c, 0) + 1
        times, new = new, self.learn(list(new))
        for c, x in new.items():
            if times[c] > 1 and len(c) <= LONGEST:
                known[c] = x
                self.bytes += len(c) + len(x[0]) + len(x[1]) + ENTRY
        for chunks in cut:
            found = [known[c] if c in known else new[c] for c in chunks]
            yield b"".join([x for x, _ in found]), "".join([x for _, x in found])[1:]
        if self.bytes > REMEMBERED:
            known.clear()
            self.bytes = 0


@lru_cache(maxsize=1)
def text_coder(path: str) -> TextCoder:
    return TextCoder(path)


def recoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, digest: Callable[[bytes], bytes | str] = bytes) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row: the ids as little-endian unsigned 32-bit numbers; ``digest`` is applied to both."""
    kind = "binary" if isinstance(digest(b""), bytes) else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(vocabulary or public_vocabulary())
        for batch in batches:
            for block in blocks_of(batch, "text", BLOCK):
                n, ids, decoded = [], [], []
                for data, text in coder.block(block.column("text").to_pylist()):
                    n.append(len(data) // 4)
                    ids.append(digest(data))
                    decoded.append(digest(text.encode()))
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], ["id", "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, n_tokens long, ids {kind}, decoded {kind}")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with batches_of(spark, 500):
        out = scratch(recoded(table(spark, sf_dir, "documents"), digest=sha256), "recoded")
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


QUERIES = {"op13_word_bpe": op13_word_bpe}
