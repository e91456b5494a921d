"""Importance resampling towards a target: hashed word n-grams, weights of buckets, and a draw without replacement.

Features are all runs of 1 to 3 consecutive words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
BUCKETS. A CRC is linear in its bytes: the CRC of a span of n bytes is a constant of n, XORed with one contribution
of each byte that depends on its distance from the span's end. A table holds the contributions of every byte value at
every distance below REACH, so the CRCs of all spans of a block come from one look-up per byte and one
``bitwise_xor.reduceat`` over the spans. Longer spans are cut into pieces of REACH bytes from their end; the sum so
far is moved over the next piece by the CRC of REACH zero bytes, which is linear as well.

Buckets are counted in each task and then added up, over the whole corpus and the whole target; the gains of BUCKETS
buckets, a fixed number, go to the tasks. Scores are weights plus Gumbel noise that depends on the id alone, so the
rows of highest scores are a draw without replacement with odds proportional to the weights' exponentials.
Ranks come from a sort by ranges and the sizes of the ranges before; no task sees more than its range.

Edge cases: null and empty texts have no features and weight 0; only A-Z are lower-cased, and words are runs of a-z,
0-9 and code points from U+0080; words and texts of any length are hashed whole; a null id draws the noise of an empty
id and comes before other ids in ties; repeated rows are ranked one after the other, each on its own; an empty
table gives an empty result, and without target texts all t are 0; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, blocks_of, scratch, table

BUCKETS = 10_000
LONGEST = 3
#: Distances from a span's end in the table, and bytes of a look-up.
REACH = 128
AT_A_TIME = 1 << 20
BLOCK = 1 << 20
FULL = np.uint32(0xFFFFFFFF)


class PositionTable:
    def __init__(self, reach: int = REACH):
        self.reach = reach
        one = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], dtype=np.uint32)
        #: What a byte at distance d from the end adds: one more zero byte behind it moves it by one.
        self.adds = np.empty((reach, 256), dtype=np.uint32)
        self.adds[0] = one
        for d in range(1, reach):
            self.adds[d] = (self.adds[d - 1] >> np.uint32(8)) ^ one[self.adds[d - 1] & np.uint32(255)]
        self.flat = self.adds.ravel()
        #: The CRC of n zero bytes, which no byte's contribution holds.
        self.constant = np.array([crc32(bytes(n)) for n in range(reach + 1)], dtype=np.uint32)
        # A register moved over ``reach`` zero bytes, by each of its four bytes.
        self.moved = np.array([[self._over(b << 8 * k, reach) for b in range(256)] for k in range(4)], dtype=np.uint32)

    @staticmethod
    def _over(register: int, zeros: int) -> int:
        return crc32(bytes(zeros), register ^ 0xFFFFFFFF) ^ 0xFFFFFFFF

    def move(self, register: np.ndarray) -> np.ndarray:
        """The register after ``reach`` further zero bytes."""
        return self.moved[0][register & 255] ^ self.moved[1][register >> 8 & 255] ^ self.moved[2][register >> 16 & 255] ^ self.moved[3][register >> 24]

    def short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """XORed contributions of spans of 1 to ``reach`` bytes, which are looked up AT_A_TIME bytes at a time."""
        out = np.empty(len(start), dtype=np.uint32)
        size = (end - start).astype(np.int64)
        sums = np.cumsum(size)
        low = 0
        while low < len(start):
            before = sums[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sums, before + AT_A_TIME, side="right")))
            n, first = size[low:high], sums[low:high] - size[low:high] - before
            k = np.arange(sums[high - 1] - before, dtype=np.int32)
            at = k + np.repeat((start[low:high] - first).astype(np.int32), n)
            distance = np.repeat((first + n - 1).astype(np.int32), n) - k
            out[low:high] = np.bitwise_xor.reduceat(self.flat[(distance << 8) + data[at]], first)
            low = high
        return out

    def crcs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of data[start:end] for each of the spans, none of them empty."""
        size = end - start
        if not len(size) or size.max() <= self.reach:
            return self.short(data, start, end) ^ self.constant[size]
        out = np.empty(len(size), dtype=np.uint32)
        long = size > self.reach
        out[~long] = self.short(data, start[~long], end[~long]) ^ self.constant[size[~long]]
        at, end = start[long], end[long]
        # The first piece takes what is over, so that all others have the whole reach.
        until = at + (end - at - 1) % self.reach + 1
        register = self.short(data, at, until) ^ self.constant[until - at] ^ FULL
        open_ = np.arange(len(at))
        while len(open_ := open_[until[open_] < end[open_]]):
            at = until[open_]
            register[open_] = self.move(register[open_]) ^ self.short(data, at, at + self.reach)
            until[open_] += self.reach
        out[long] = register ^ FULL
        return out


@lru_cache(maxsize=1)
def position_table() -> PositionTable:
    return PositionTable()


#: Byte to itself in lower case if it belongs to a word, else to a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(texts: list[str | None], crcs: PositionTable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, text of each feature, bucket of each feature)."""
    # Split and joined, words are one blank apart; a line break ends a text.
    lines = [b" ".join((t or "").encode().translate(WORD_BYTES).split()) for t in texts]
    data = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    text = np.repeat(np.arange(len(lines)), np.bincount(np.searchsorted(np.flatnonzero(data == 10), ends), minlength=len(lines)))
    has = ends > starts  # an empty text leaves one empty word
    starts, ends, text = starts[has], ends[has], text[has]
    whose, buckets = [], []
    for n in range(1, min(LONGEST, len(starts)) + 1):
        last = len(starts) - n + 1
        same = text[:last] == text[n - 1 :]
        hashed = (crcs or position_table()).crcs(data, starts[:last][same], ends[n - 1 :][same])
        whose.append(text[:last][same])
        buckets.append((hashed % np.uint32(BUCKETS)).astype(np.int64))
    empty = np.zeros(0, np.int64)
    return np.bincount(text, minlength=len(lines)), np.concatenate([empty, *whose]), np.concatenate([empty, *buckets])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; a task gives one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for block in blocks_of(batch, "text", BLOCK):
                counts += np.bincount(features(block.column("text").to_pylist())[2], minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])
        pa.default_memory_pool().release_unused()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    with batches_of(docs.sparkSession, 500):
        rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log odds of each bucket, with one more feature in every bucket of both."""
    odds = (target + 1.0) * (source.sum() + BUCKETS) / ((source + 1.0) * (target.sum() + BUCKETS))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch, "text", BLOCK):
                words, whose, buckets = features(block.column("text").to_pylist())
                # Sums of whole numbers below 2**53 are exact.
                weight = np.bincount(whose, shared.value[buckets].astype(float), minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(words), pa.array(np.bincount(whose, minlength=len(words))), pa.array(weight)], ["id", "n_words", "n_features", "weight"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 on in this order: numbered within ranges, plus the sizes of the ranges before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(n + 1, n + batch.num_rows + 1))], [*batch.schema.names, "r_part", "r_here"])
            n += batch.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = scratch(sorted_.mapInArrow(run, f"{fields}, r_part long, r_here long"), "ranked")
    # One row for each range.
    sizes = dict(numbered.groupBy("r_part").count().collect())
    before, parts = 0, []
    for part in sorted(sizes):
        parts.append((part, before))
        before += sizes[part]
    base = rows.sparkSession.createDataFrame(parts, "r_part long, r_before long")
    return numbered.join(F.broadcast(base), "r_part").select(*rows.columns, (F.col("r_before") + F.col("r_here")).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of each row: rank counts the drawn rows from the highest score on, null for the rest."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    with batches_of(docs.sparkSession, 500):
        noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
        scored = scratch(weighted(docs, gain, id_col, text_col).select("id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("may"), F.monotonically_increasing_id().alias("row")), "scored")
    drawn = scored.filter("may").count() * percent // 100
    placed = ranked(scored.filter("may").select("id", "n_features", "weight", "score", "row"), F.desc("score"), F.asc("id"), F.asc("row"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.filter("not may").withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).select("id", "n_features", "weight", "score", "rank").unionByName(rest.select("id", "n_features", "weight", "score", "rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_importance": op11_importance}
