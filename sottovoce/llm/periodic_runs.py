"""Periodic stretches of words (runs), found on a grammar of the text, and texts with their repetitions collapsed.

A run is a stretch with smallest period q, of at least ``least`` words and ``periods`` periods, that no neighbouring
word extends. The word ids of a block of documents are compressed by Re-Pair: pairs that occur twice or more become
nonterminals, the most frequent first; pairs that do not overlap are replaced in one round, and their counts are
renewed. A run lies within the expansion of some nonterminal and across the boundary of its two parts, or across a
boundary of the start sequence of its document. So each boundary of a nonterminal is looked at once, in the first
place where the nonterminal stands, however often the grammar derives it; what is found is translated to all places of
the derivation, and stretches that end only where an expansion ends are merged into the maximal one around them.

At a boundary, one side of a run has half of its words, so a block of w words beside the boundary, w at most half the
period, returns one period away. Blocks of 1, 2, 4, ... words are named, equal blocks of a document alike, by pairs of
names of half their length; only blocks that return in their document keep a name. The names give the periods
to try and, descending through the lengths, how far each reaches. Names are exact, so nothing is left to verify.

Edge cases: null and empty texts have no words and no runs and collapse to the empty text; a word is a run of code
points other than space and the controls 9 to 13; very long texts are a block of their own; repeated rows give repeated
results; null ids are carried; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, blocks_of, scratch, table

#: Bytes of text whose documents share a grammar.
BLOCK = 2 << 20
#: Candidates that are measured at a time.
AT_A_TIME = 1 << 18
#: The shortest block that has to return: with 24 words and 3 periods, half of a run has 4 words beyond its period.
SHORTEST = 4


class Grammar(NamedTuple):
    """Symbols below ``n_words`` are words, symbol n_words + i is rule i. ``rounds`` has the first rule of each round and the number of rules."""

    n_words: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # of every symbol
    first: np.ndarray  # the place where the rule is first derived
    rounds: list[int]
    sequence: np.ndarray
    place: np.ndarray  # of each symbol of the sequence


def _scattered(keys: np.ndarray) -> np.ndarray:
    """Settles which of equally frequent pairs is first, so that neighbours do not wait for each other in long chains."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) >> np.uint64(12)


def re_pair(words: np.ndarray, n_words: int) -> Grammar:
    sequence, place = words.astype(np.int64), np.arange(len(words))
    left, right, first, length = (np.zeros(0, np.int64) for _ in range(4))
    length = np.ones(n_words, np.int64)
    keys, rounds = np.zeros(0, np.int64), [0]
    symbols = n_words + len(words)
    # Pairs counted once are left out until nothing else repeats; then all are counted again.
    may, every = np.ones(max(len(words) - 1, 0), bool), True
    while True:
        at = np.flatnonzero(may)
        pairs = sequence[at] * symbols + sequence[at + 1]
        kinds, kind, count = np.unique(pairs, return_inverse=True, return_counts=True)
        order = np.lexsort((_scattered(kinds), count))
        rank = np.empty(len(kinds), np.int64)
        rank[order] = np.arange(1, len(kinds) + 1)
        rank[count < 2] = 0
        # Stretches of one pair (as in a a a) are one contender; those above both neighbours are replaced.
        strength = np.zeros(len(sequence) + 1, np.int64)
        strength[at + 1] = rank[kind]
        edges = np.flatnonzero(np.diff(strength)) + 1
        begins, ends = edges[:-1], edges[1:]
        own = strength[begins]
        wins = (own > strength[begins - 1]) & (own > strength[np.minimum(ends, len(strength) - 1)]) if len(begins) else np.zeros(0, bool)
        begins, size = begins[wins] - 1, (ends - begins)[wins]
        if not len(begins) and every:
            break
        if not len(begins):
            may, every = np.ones(len(sequence) - 1, bool), True
            continue
        every = False
        half = (size + 1) // 2
        taken = np.repeat(begins - 2 * (np.cumsum(half) - half), half) + 2 * np.arange(half.sum())
        made = sequence[taken] * symbols + sequence[taken + 1]
        new, where = np.unique(made, return_index=True)
        known = np.isin(new, keys)
        fresh = new[~known]
        left, right = np.concatenate([left, fresh // symbols]), np.concatenate([right, fresh % symbols])
        length = np.concatenate([length, length[fresh // symbols] + length[fresh % symbols]])
        first = np.concatenate([first, place[taken[where[~known]]]])
        keys = np.concatenate([keys, fresh])
        rounds.append(len(keys))
        order = np.argsort(keys)
        may = np.zeros(len(sequence), bool)
        may[at] = rank[kind] > 0
        may[taken] = True
        may[np.maximum(taken - 1, 0)] = True
        sequence[taken] = n_words + order[np.searchsorted(keys[order], made)]
        stays = np.ones(len(sequence), bool)
        stays[taken + 1] = False
        sequence, place, may = sequence[stays], place[stays], may[stays][:-1]
    return Grammar(n_words, left, right, length, first, rounds, sequence, place)


class Names:
    """Names of the blocks of 1, 2, 4, ... words that return in their document; 0 elsewhere."""

    def __init__(self, words: np.ndarray, document: np.ndarray):
        self.size = n = len(words)
        self.levels: list[np.ndarray] = []
        self.listed: list[np.ndarray] = []
        at, keys, width = np.arange(n), document * (words.max(initial=0) + 1) + words, 1
        while len(at):
            _, kind, count = np.unique(keys, return_inverse=True, return_counts=True)
            returns = count[kind] > 1
            at, kind = at[returns], kind[returns] + 1
            if not len(at):
                break
            dense = np.zeros(n + 1, np.int64)
            dense[at] = kind
            self.levels.append(dense)
            #: Name and place in one number, in order.
            self.listed.append(np.sort(kind * (n + 1) + at))
            other = at + width
            pair = other < n
            at, other = at[pair], other[pair]
            pair = dense[other] > 0
            at, other = at[pair], other[pair]
            keys, width = dense[at] * (n + 1) + dense[other], 2 * width

    def same_after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words from x and y on."""
        out = np.zeros(len(x), np.int64)
        for level in reversed(range(len(self.levels))):
            name = self.levels[level]
            a = name[np.minimum(x + out, self.size)]
            out += ((a > 0) & (a == name[np.minimum(y + out, self.size)])).astype(np.int64) << level
        return out

    def same_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words before x and y."""
        out = np.zeros(len(x), np.int64)
        for level in reversed(range(len(self.levels))):
            name = self.levels[level]
            a, b = x - out - (1 << level), y - out - (1 << level)
            inside = (a >= 0) & (b >= 0)
            found = name[np.where(inside, a, self.size)]
            out += ((found > 0) & (found == name[np.where(inside, b, self.size)])).astype(np.int64) << level
        return out


def crossing(names: Names, low: np.ndarray, boundary: np.ndarray, high: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, ...]:
    """(boundary's number, start, end, period) of the stretches across each boundary within [low, high)."""
    found: list[tuple[np.ndarray, ...]] = []
    for level in range(SHORTEST.bit_length() - 1, len(names.levels)):
        width = 1 << level
        near, far = (1 if width == SHORTEST else 2 * width), 4 * width
        name, listed, step = names.levels[level], names.listed[level], names.size + 1
        wide = np.flatnonzero(high - low >= max(least, periods * near))
        for after in (True, False):
            own = boundary[wide] if after else boundary[wide] - width
            has = own >= low[wide]
            who, own = wide[has], own[has]
            named = name[own] > 0
            who, own = who[named], own[named]
            base = name[own] * step
            if after:
                begin, end = own + near, np.minimum(own + far, high[who])
            else:
                begin, end = np.maximum(own - far + 1, low[who]), own - near + 1
            at, to = np.searchsorted(listed, base + begin), np.searchsorted(listed, base + np.maximum(end, begin))
            many = to - at
            some = many > 0
            who, own, at, many = who[some], own[some], at[some], many[some]
            sums = np.cumsum(many)
            cut = 0
            while cut < len(who):
                until = max(cut + 1, int(np.searchsorted(sums, (sums[cut - 1] if cut else 0) + AT_A_TIME, side="right")))
                n = many[cut:until]
                index = np.repeat(at[cut:until] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                k = np.repeat(who[cut:until], n)
                period = np.abs(listed[index] % step - np.repeat(own[cut:until], n))
                y = boundary[k] + (period if after else 0)
                x = y - period
                start, stop = np.maximum(x - names.same_before(x, y), low[k]), np.minimum(y + names.same_after(x, y), high[k])
                good = (stop - start >= np.maximum(least, periods * period)) & (start < boundary[k]) & (stop > boundary[k])
                found.append((k[good], start[good], stop[good], period[good]))
                cut = until
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    k, start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # Multiples of a period give the same stretch; the smallest one is its period.
    order = np.lexsort((period, stop, start, k))
    k, start, stop, period = k[order], start[order], stop[order], period[order]
    new = np.append(True, (k[1:] != k[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(k)]
    return k[new], start[new], stop[new], period[new]


def translated(grammar: Grammar, rule: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches given relative to their rule's expansion, in all places of the derivation."""
    base = grammar.n_words
    has = np.zeros(base + len(grammar.left), bool)
    has[base + rule] = True
    leads = has.copy()
    for a, b in zip(grammar.rounds[:-1], grammar.rounds[1:], strict=True):
        leads[base + a : base + b] |= leads[grammar.left[a:b]] | leads[grammar.right[a:b]]
    order = np.argsort(rule, kind="stable")
    rule, start, stop, period = rule[order], start[order], stop[order], period[order]
    out = []
    symbol, place = grammar.sequence, grammar.place
    while True:
        keep = leads[symbol]
        symbol, place = symbol[keep], place[keep]
        if not len(symbol):
            break
        here = has[symbol]
        low, high = (np.searchsorted(rule, symbol[here] - base, side=s) for s in ("left", "right"))
        n = high - low
        index, shift = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(place[here], n)
        out.append((start[index] + shift, stop[index] + shift, period[index]))
        left, right = grammar.left[symbol - base], grammar.right[symbol - base]
        symbol, place = np.concatenate([left, right]), np.concatenate([place, place + grammar.length[left]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def maximal(start: np.ndarray, stop: np.ndarray, period: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Without the stretches that lie within another one of the same period, by start and period."""
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = np.maximum.accumulate(stop + period * (size + 1)) if len(stop) else stop
    new = np.append(True, stop[1:] + period[1:] * (size + 1) > reach[:-1])[: len(stop)]
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def runs_of(documents: list[list[bytes]], least: int = 24, periods: int = 3) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, in the order of documents, starts and periods; starts count from 0."""
    numbers: dict[bytes, int] = {}
    parts = []
    for words in documents:
        parts += [numbers.setdefault(w, len(numbers)) for w in words]
        parts.append(-1)
    # A symbol of its own after each document is in no pair.
    words = np.array(parts, dtype=np.int64)
    sizes = np.array([len(x) for x in documents], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    words[ends] = len(numbers) + np.arange(len(ends))
    document = np.repeat(np.arange(len(ends)), sizes + 1)
    n_words = len(numbers) + len(ends)
    grammar, names = re_pair(words, n_words), Names(words, document)
    # Boundaries of rules long enough, then those of the documents' sequences.
    rule = np.flatnonzero(grammar.length[n_words:] >= least)
    low = grammar.first[rule]
    middle = low + grammar.length[grammar.left[rule]]
    inner = (grammar.sequence[:-1] < len(numbers)) | (grammar.sequence[:-1] >= n_words)
    after = grammar.sequence[1:]
    top = grammar.place[1:][inner & ((after < len(numbers)) | (after >= n_words))]
    whose = document[top]
    k, start, stop, period = crossing(names, np.concatenate([low, begins[whose]]), np.concatenate([middle, top]), np.concatenate([low + grammar.length[n_words:][rule], ends[whose]]), least, periods)
    inside = k < len(rule)
    x = k[inside]
    more = translated(grammar, rule[x], start[inside] - low[x], stop[inside] - low[x], period[inside])
    start, stop, period = maximal(*(np.concatenate([a[~inside], b]) for a, b in zip((start, stop, period), more, strict=True)), len(words))
    whose = document[start]
    return whose, start - begins[whose], stop - start, period


def collapsed(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> bytes:
    """The words that are in no run or in the first period of every run that has them, joined by blanks."""
    if not start:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in zip(start, length, period, strict=True):
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = 24, periods: int = 3, id_col: str = "doc_id", text_col: str = "text", words_of: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, best, collapsed) of each row.

    runs is an array of (start, length, period) by start, then period; best is the run of greatest length / period, of
    equal ones the first by start, then period, or null. ``words_of`` may change a document's words before.
    """
    if least < 24 or periods < 3:
        raise ValueError("runs need 24 words and 3 periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch, "text", BLOCK):
                # Bytes are split at the blanks of ASCII only, which are the separators.
                documents = [(t or "").encode().split() for t in block.column("text").to_pylist()]
                if words_of:
                    documents = [words_of(i, w) for i, w in zip(block.column("id").to_pylist(), documents, strict=True)]
                whose, start, length, period = runs_of(documents, least, periods)
                edges = np.searchsorted(whose, np.arange(len(documents) + 1))
                s, n, q = start.tolist(), length.tolist(), period.tolist()
                best, texts = [], []
                for words, a, b in zip(documents, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    texts.append(collapsed(words, s[a:b], n[a:b], q[a:b]))
                    top = max(range(a, b), key=lambda i: (Fraction(n[i], q[i]), -s[i], -q[i]), default=None)
                    best.append(None if top is None else {"start": s[top], "length": n[top], "period": q[top]})
                runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN)))
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([len(w) for w in documents], pa.int64()), runs, pa.array(best, RUN), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "best", "collapsed"])
        pa.default_memory_pool().release_unused()

    run_type = "struct<start: long, length: long, period: long>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id long, n_words long, runs array<{run_type}>, best {run_type}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    each = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the number of their id, end in a repeated period; documents without an id stay as they are."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a, n = g % len(words), len(words)
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with batches_of(spark, 500):
        return scratch(digests(periodic_runs(table(spark, sf_dir, "documents"), words_of=planted)), "runs")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
