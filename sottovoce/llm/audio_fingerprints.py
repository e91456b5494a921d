"""Chroma fingerprints and alignment of recordings.

A recording is a series of pitch-class frames (12 energies each). Filters over rectangles of the time-pitch image,
summed by an integral image, are quantised to two bits each; 16 filters make a 32-bit number for every window of
16 frames. Recordings are aligned by votes for offsets: a vote is a pair of numbers that are equal but for one bit, or
but for two bits whose values lie next to a quantisation step (any two bits, where the query is short and has few
windows to vote). Of the offsets with votes, those whose share of unequal bits over the whole overlap is low enough
match, and the one with most votes is given.

By chance alone, pairs of numbers agree in proportion to queries times recordings. The join therefore looks at the
numbers around both places too, and a vote counts only if no more than ``LOOSE`` of their bits differ.

Recordings with equal fingerprints form a class, and only class representatives are compared; a query set is
searched against all of them. The tolerated bits are set on the side of the queries, so the other side is read once.
Recordings that share no vote are not compared: a copy with a fifth of its words replaced can be lost (see README).
Overlaps under ``least_overlap`` windows are no match, so recordings of 16 to 30 frames have a class but no match.

Here frames come from text (``chroma_of_text``): each word is a note with two overtones, set by its hash. Any
other source of frames can take its place.

Edge cases: null and empty texts and recordings under 16 frames have no fingerprint and match nothing; repeated
rows are members of one class; rows with a null id are members but no queries; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, scratch, table

FRAMES, PITCHES = 16, 12
#: The filters by rule: (kind, first pitch, number of pitches, number of frames).
FILTERS = [(k % 3, (5 * k) % 9, 3 + k % 4 if (5 * k) % 9 + 3 + k % 4 <= PITCHES else 3, 4 + 4 * (k % 4)) for k in range(16)]
#: Quantisation steps of the log ratio, and codes in which neighbours differ in one bit.
STEPS = np.array([-0.35, 0.0, 0.35])
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Bits nearest a step, of which any two may differ; a query of fewer windows than SHORT tolerates any two of all 32.
NEAR, SHORT = 8, 48
#: Windows around a vote that are compared as well, and the share of their bits that may differ (by chance, half do).
AROUND, LOOSE = (-12, -6, -3, 3, 6, 12), 0.3
ONE = np.array([0, *(1 << k for k in range(32))], dtype=np.uint32)
TWO = np.array([1 << a | 1 << b for a, b in combinations(range(32), 2)], dtype=np.uint32)


def chroma_of_text(text: str) -> np.ndarray:
    words = text.lower().split()
    h = np.fromiter((crc32(w.encode()) for w in words), dtype=np.uint32, count=len(words))
    out = np.zeros((len(h), PITCHES))
    for shift, energy in ((0, 1.0), (8, 0.5), (16, 0.25)):
        np.add.at(out, (np.arange(len(h)), (h >> np.uint32(shift)) % PITCHES), energy)
    return out


def filtered(chroma: np.ndarray) -> np.ndarray:
    """The log ratios of the filters, a row for each window of ``FRAMES`` frames."""
    n = len(chroma) - FRAMES + 1
    if n <= 0:
        return np.empty((0, len(FILTERS)))
    integral = np.zeros((len(chroma) + 1, PITCHES + 1))
    integral[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]

    out = np.zeros((n, len(FILTERS)))
    for k, (kind, low, pitches, frames) in enumerate(FILTERS):
        high = low + pitches
        if kind == 0:
            a, b = area(0, frames // 2, low, high), area(frames // 2, frames, low, high)
        elif kind == 1:
            a, b = area(0, frames, low, low + pitches // 2 + 1), area(0, frames, low + pitches // 2 + 1, high)
        else:
            a, b = area(frames // 4, frames - frames // 4, low, high), area(0, frames // 4, low, high) + area(frames - frames // 4, frames, low, high)
        out[:, k] = np.round(np.log((1 + a) / (1 + b)), 9)
    return out


def numbers(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint32)
    for level in np.searchsorted(STEPS, values.T, side="right"):
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """One 32-bit number for each window of ``FRAMES`` frames."""
    return numbers(filtered(chroma))


def near_bits(values: np.ndarray) -> np.ndarray:
    """By window, the ``NEAR`` bits that the least changes of values would turn."""
    level, at = np.searchsorted(STEPS, values, side="right"), 2 * np.arange(len(FILTERS) - 1, -1, -1)
    far, bits = [], []
    for s, step in enumerate(STEPS):
        far.append(np.where((level == s) | (level == s + 1), np.abs(values - step), np.inf))
        bits.append(at + int(GRAY[s] ^ GRAY[s + 1]).bit_length() - 1)
    order = np.argsort(np.hstack(far), axis=1, kind="stable")[:, :NEAR]
    return np.concatenate(bits).astype(np.uint8)[order]


def probes(marks: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers) that vote for each window of a query; no number twice for a window."""
    if len(marks) < SHORT:
        masks = np.broadcast_to(np.concatenate([ONE, TWO]), (len(marks), len(ONE) + len(TWO)))
    else:
        bit = np.uint32(1) << near.astype(np.uint32)
        masks = np.hstack([np.broadcast_to(ONE, (len(marks), len(ONE))), *((bit[:, a] | bit[:, b])[:, None] for a, b in combinations(range(NEAR), 2))])
    return np.repeat(np.arange(len(marks), dtype=np.int32), masks.shape[1]), (marks[:, None] ^ masks).ravel()


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(overlap, unequal bits) with position i of a over i - offset of b."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    x = a[low:high] ^ b[low - offset : high - offset]
    return max(0, high - low), int(np.unpackbits(x.view(np.uint8)).sum()) if len(x) else 0


def fingerprints(recordings: DataFrame, is_query: str = "false") -> DataFrame:
    """(id, marks binary, near binary, class_key) from (id, text); near bits of queries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [filtered(chroma_of_text(t or "")) for t in batch.column("text").to_pylist()]
            near = [near_bits(v).tobytes() if asks else None for v, asks in zip(values, batch.column("asks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([numbers(v).tobytes() for v in values], pa.binary()), pa.array(near, pa.binary())], ["id", "marks", "near"])

    made = recordings.select("id", "text", F.expr(is_query).alias("asks")).mapInArrow(run, "id long, marks binary, near binary")
    return made.withColumn("class_key", F.when(F.length("marks") > 0, F.sha2("marks", 256)))


def _exploded(classes: DataFrame, name: str) -> DataFrame:
    """(id, pos, key, around) of each number; of queries (with near bits) of each number that votes."""
    asks, around = name == "q", [f"{name}_{k}" for k in range(len(AROUND))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (i, m) in enumerate(zip(batch.column("id"), batch.column("marks"), strict=True)):
                keys = np.frombuffer(m.as_buffer(), dtype=np.uint32)
                pos = np.arange(len(keys), dtype=np.int32)
                seen, n = keys.view(np.int32), len(keys)
                if asks:
                    pos, keys = probes(keys, np.frombuffer(batch.column("near")[k].as_buffer(), dtype=np.uint8).reshape(-1, NEAR))
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i.as_py())), pa.array(pos), pa.array(keys.view(np.int32)), *(pa.array(seen[np.clip(pos + d, 0, n - 1)], mask=(pos + d < 0) | (pos + d >= n)) for d in AROUND)], ["id", "pos", "key", *around])

    made = classes.select("id", "marks", *(["near"] if asks else [])).mapInArrow(run, "id long, pos int, key int, " + ", ".join(f"{c} int" for c in around))
    return made.select(F.col("id").alias(f"{name}_id"), F.col("pos").alias(f"{name}_pos"), "key", *around)


def _alike() -> Column:
    """Whether the numbers around a vote that both sides have differ in few enough bits."""
    unequal = [F.bit_count(F.col(f"q_{k}").bitwiseXOR(F.col(f"m_{k}")).bitwiseAND(F.lit(0xFFFFFFFF))) for k in range(len(AROUND))]
    wrong = sum((F.coalesce(x, F.lit(0)) for x in unequal), F.lit(0))
    bits = sum((F.when(x.isNotNull(), 32).otherwise(0) for x in unequal), F.lit(0))
    return wrong <= LOOSE * bits


def align(recordings: DataFrame, is_query: str, max_error: float = 0.25, least_overlap: int = 16) -> tuple[DataFrame, DataFrame]:
    """(members, matches): members (id, class_id); matches (query_id, match_id, offset, votes, overlap, bit_errors).

    ``is_query`` is an SQL condition on ``id``; matches are between class representatives (the least id of a class).
    """
    spark = recordings.sparkSession
    with batches_of(spark, 1000):
        made = scratch(fingerprints(recordings, is_query), "fingerprints")
    classes = made.filter("class_key is not null and id is not null").groupBy("class_key").agg(F.min("id").alias("class_id"), F.max(F.expr(is_query)).alias("query"), F.first("marks").alias("marks"), F.max("near").alias("near"))
    classes = scratch(classes, "recording-classes")
    members = made.select("id", "class_key").join(classes.select("class_key", "class_id"), "class_key", "left").select("id", "class_id")
    heads = classes.select(F.col("class_id").alias("id"), "marks", "near", "query")
    asked = scratch(_exploded(heads.filter("query"), "q"), "query-votes")
    same = asked.join(_exploded(heads, "m"), "key").filter("q_id != m_id").filter(_alike())
    counted = same.groupBy("q_id", "m_id", (F.col("q_pos") - F.col("m_pos")).alias("offset")).agg(F.count("*").alias("votes"))
    # Most votes first; of equal ones the least shift, then the lower one. There are as many as offsets at most.
    tried = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("votes"), F.abs("offset").alias("shift"), "offset")))
    pairs = scratch(counted.groupBy("q_id", "m_id").agg(tried.alias("tried")), "offsets")
    for side in ("q", "m"):
        pairs = pairs.join(heads.select(F.col("id").alias(f"{side}_id"), F.col("marks").alias(f"{side}_marks")), f"{side}_id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q_id, m_id, q, m, tried in zip(*(batch.column(c) for c in ("q_id", "m_id", "q_marks", "m_marks", "tried")), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (q, m))
                for x in tried.as_py():
                    n, errors = bit_errors(a, b, x["offset"])
                    if n >= least_overlap and errors <= max_error * 32 * n:
                        rows.append((q_id.as_py(), m_id.as_py(), x["offset"], -x["votes"], n, errors))
                        break
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if name == "offset" else pa.int64()) for name, c in zip(found, columns, strict=True)], found)

    found = ["query_id", "match_id", "offset", "votes", "overlap", "bit_errors"]
    matches = pairs.select("q_id", "m_id", "tried", "q_marks", "m_marks").mapInArrow(judge, "query_id long, match_id long, offset int, votes long, overlap long, bit_errors long")
    return members, matches


def op7_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a recording, those of every fiftieth conversation as queries: one row for each
    recording with its class, and one for each match between classes. A recording's id is conv_id times one more than
    the longest conversation's last turn, plus its turn."""
    turns = table(spark, sf_dir, "conversations")
    step = int(turns.agg(F.coalesce(F.max("turn"), F.lit(0)) + 1).first()[0])
    members, matches = align(turns.select((F.col("conv_id") * step + F.col("turn")).alias("id"), "text"), f"floor(id / {step}) % 50 = 0")
    none = F.lit(None).cast("long")
    rows = members.select(F.lit("member").alias("kind"), "id", "class_id", none.alias("match_id"), none.alias("offset"), none.alias("votes"), none.alias("overlap"), none.alias("bit_errors"))
    found = matches.select(F.lit("match").alias("kind"), F.col("query_id").alias("id"), F.col("query_id").alias("class_id"), "match_id", F.col("offset").cast("long").alias("offset"), "votes", "overlap", "bit_errors")
    return rows.unionByName(found)


QUERIES = {"op7_audio_fingerprints": op7_audio_fingerprints}
