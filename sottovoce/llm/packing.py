"""Mixture-controlled packing of tokenised documents into windows.

Each source is a queue of tokens, served in quanta of ``quantum`` tokens. A window takes quanta by deficit
round-robin: every source earns credit in proportion to its target, and the source whose next quantum has been
due longest is served, so its deficit is carried from window to window. The turn of a quantum has a closed form
(its place among all sources' due times), so the schedule needs no state that moves between tasks: partitions
learn only where their part of each queue begins.

By default a source's target is its share of all tokens, and all queues run dry together. With given weights,
queues that run dry leave their credit to the others. The ends of the queues, shorter than a quantum, fill the
last windows. Every token is in exactly one piece; only the last window is not full.

Pass 1 tokenises each text once, with its place in its task's part of the queue, into a table. Pass 2 reads that
table with the queue offsets and cuts the pieces. Neither deals documents out by source.

Edge cases: a null or empty text is the closing id alone; a null source is a queue of its own; repeated rows are
packed as often as they occur; an empty table gives an empty result; a null id is carried as null; other columns
are ignored; a very long text is tokenised whole and cut into as many pieces as it needs. Every source has a queue of
its own: tasks know 32 bytes of each, and the time for a batch grows with their number.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, scratch, table

#: Chunks whose ids a worker remembers, and the longest of them. The first half, where frequent ones are, stays; the second makes room when full.
REMEMBERED, LONGEST = 100_000, 100
CLOSING_ID = 0


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Chunk of text to the bytes of its ids; unknown chunks are encoded when first asked for."""

    def __init__(self, as_bytes: Callable[[str], bytes]):
        self.as_bytes = as_bytes

    def __missing__(self, chunk: str) -> bytes:
        ids = self.as_bytes(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                for late in list(self)[REMEMBERED // 2 :]:
                    del self[late]
            self[chunk] = ids
        return ids


def byte_level_encoder(path: str) -> tuple[Callable[[str], list[int]], int]:
    """Encoder and number of ids for a byte-level BPE file. Where ids follow the order of merges, as they do in the public file,
    a rank-based encoder gives the same ids faster; any other file goes through its own library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        import public_tokenizers
        import tiktoken

        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, len(ranks)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids, whole.get_vocab_size()


def id_type(ids: int) -> str:
    """The array type code of numbers that hold so many ids."""
    return "H" if ids <= 1 << 16 else "I"


@lru_cache(maxsize=2)
def text_encoder(path: str) -> tuple[Callable[[str], bytes], str]:
    """Whole texts to the bytes of their ids, and the numbers' type; made once in each process.

    A blank before a word belongs to that word, a single line break between words stands alone, and so does a
    comma or full stop between a letter or digit and a blank or line break. Where a text has no other white space
    and no mark before such a comma or stop, it is cut there without changing its ids, and each chunk is encoded once.
    """
    import re

    encode, size = byte_level_encoder(path)
    kind = id_type(size)

    def as_bytes(text: str) -> bytes:
        return array(kind, encode(text)).tobytes()

    known = WordIds(as_bytes)
    # A comma or stop that follows another mark or a blank would be one piece with it.
    after_mark = re.compile(r"[\W_][.,][ \n]")

    def even(text: str) -> bool:
        return " ".join(text.split()) == text.replace("\n", " ") and "\0" not in text and text[0] not in ".," and not after_mark.search(text)

    def ids(text: str) -> bytes:
        if not text:
            return b""
        if not even(text):
            return as_bytes(text)
        for mark in (", ", ". ", ",\n", ".\n"):
            text = text.replace(mark, f"\0{mark}")
        text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return b"".join(map(known.__getitem__, text.split("\0")))

    return ids, kind


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None) -> DataFrame:
    """(id, queue, part, pos, n, ids): pos counts the tokens of the queue before this document in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = text_encoder(vocabulary or public_vocabulary())
        close = array(kind, [CLOSING_ID]).tobytes()
        part, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [encode(t or "") + close for t in batch.column("text").to_pylist()]
            pos, n = [], []
            for queue, x in zip(batch.column("queue").to_pylist(), ids, strict=True):
                n.append(len(x) // len(close))
                pos.append(at.get(queue, 0))
                at[queue] = pos[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("queue"), pa.array([part] * len(n), pa.int32()), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["id", "queue", "part", "pos", "n", "ids"])
        pa.default_memory_pool().release_unused()

    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), source.alias("queue")).mapInArrow(run, "id long, queue string, part int, pos long, n long, ids binary")


def turn(served: np.ndarray, index: np.ndarray, quanta: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How many quanta are served before quantum ``index`` of queue ``served``; ties go to the earlier queue.

    Quantum i of a queue of weight w is due at (i + 0.5) / w.
    """
    due = ((index + 0.5) / weights[served])[:, None]
    out = np.zeros(len(index), dtype=np.int64)
    step = max(1, 200_000 // max(1, len(index)))
    for low in range(0, len(quanta), step):
        q = np.arange(low, min(low + step, len(quanta)))[None, :]
        w, total, earlier = weights[q], quanta[q], q < served[:, None]
        # The count is estimated and then settled by the comparison itself, so that all tasks agree.
        g = np.clip(np.ceil(due * w - 0.5), 0, total).astype(np.int64)
        for _ in range(2):
            there = (g + 0.5) / w
            g += (g < total) & ((there < due) | ((there == due) & earlier))
            there = (g - 0.5) / w
            g -= (g > 0) & ~((there < due) | ((there == due) & earlier))
        out += g.sum(axis=1)
    return out


def pack(docs: DataFrame, window: int = 1024, quantum: int = 128, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids); ids as little-endian 32-bit numbers."""
    if window % quantum:
        raise ValueError("the window has to be a multiple of the quantum")
    with batches_of(docs.sparkSession, 500):
        tokens = scratch(tokenised(docs, id_col, text_col, source_col, vocabulary), "tokens")
    totals = tokens.groupBy("queue", "part").agg(F.sum("n").alias("total"))
    base = F.sum("total").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch(totals.select("queue", "part", F.coalesce(base, F.lit(0)).alias("base"), "total"), "offsets")
    # One row for each source.
    queues = sorted((r["queue"], r["n"]) for r in offsets.groupBy("queue").agg(F.sum("total").alias("n")).collect())
    names = {q: i for i, (q, _) in enumerate(queues)}
    sizes = np.array([n for _, n in queues], dtype=np.int64)
    quanta = sizes // quantum
    share = np.array([float((weights or {}).get(None if q == "null" else q[1:], 0)) for q, _ in queues]) if weights else np.maximum(quanta, 1).astype(float)
    if (share <= 0).any():
        raise ValueError("every source needs a positive weight")
    full = int(quanta.sum())
    ends = full * quantum + np.concatenate([[0], np.cumsum(sizes - quanta * quantum)[:-1]]) if len(sizes) else sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 250) for whole in batches for i in range(0, whole.num_rows, 250)):
            held = batch.column("ids")
            n = batch.column("n").to_numpy()
            queue = np.array([names[q] for q in batch.column("queue").to_pylist()])
            begin = batch.column("base").to_numpy() + batch.column("pos").to_numpy()
            first, last = begin // quantum, (begin + n - 1) // quantum
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            index = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(index * quantum, begin[row])
            size = np.minimum((index + 1) * quantum, (begin + n)[row]) - low
            q, tail = queue[row], index >= quanta[queue[row]]
            at = np.where(tail, ends[q] - quanta[q] * quantum + low, 0)
            at[~tail] = turn(q[~tail], index[~tail], quanta, share) * quantum + low[~tail] % quantum
            # A piece from a queue's end may cross into the next window.
            over = np.maximum(at % window + size - window, 0)
            cut = np.flatnonzero(over)
            where = np.concatenate([np.arange(len(row)), cut])
            row, at, low, size = row[where], at[where], low[where], (size - over)[where]
            if len(cut):
                new = slice(len(row) - len(cut), None)
                at[new] += size[new]
                low[new] += size[new]
                size[new] = over[cut]
            # The pieces of a document in order are its ids in order, so the ids of a batch are cut where they lie.
            order = np.lexsort((low, row))
            row, at, low, size = row[order], at[order], low[order], size[order]
            edges = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]
            width = int(edges[-1] - edges[0]) // int(n.sum())
            ids = np.frombuffer(held.buffers()[2], dtype=f"<u{width}")[edges[0] // width : edges[-1] // width].astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(low - begin[row]), pa.array(size), pa.array(n[row]), pa.array(at // window), pa.array(at % window), pieces], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        pa.default_memory_pool().release_unused()

    placed = tokens.join(offsets.select("queue", "part", "base"), ["queue", "part"])
    return placed.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


QUERIES = {"op6_packing": op6_packing}
