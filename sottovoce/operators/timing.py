"""Timecodes: limits, merging, speech and shot suggestions, re-splitting, edits and span detection.

What depends on the cue already changed before it is in ``moves``; everything else is a window, a range join within
a file, or an aggregation.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sottovoce.functions.split import pieces as pieces_of
from sottovoce.functions.split import weighted
from sottovoce.functions.text import BLANKS, trimmed
from sottovoce.operators.moves import apply_spotting, converge, take_points
from sottovoce.operators.near import meeting
from sottovoce.operators.walks import walked

__all__ = ["apply_spotting", "converge"]


def by_start() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("start_ms", "idx")


def by_idx() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("idx")


def _walk(max_duration_ms: int, max_gap_ms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cues by file and number, in any batches, to merged ones; only the last cue is kept from one row to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[Any] | None = None  # file, number, start, end, texts
        done: list[list[Any]] = []

        def given() -> pa.RecordBatch:
            rows, done[:] = list(done), []
            # A part is cut at both ends as it is added, so what stood at the ends of the whole goes; a missing text leaves none.
            texts = [None if None in parts else parts[0] if len(parts) == 1 else reduce(lambda said, x: f"{said} {x}".strip(BLANKS), parts) for *_, parts in rows]
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate((file_type, pa.int32(), pa.int64(), pa.int64()))), pa.array(texts, pa.string())], names=["file_id", "idx", "start_ms", "end_ms", "text"])

        file_type = pa.int64()
        for batch in batches:
            file_type = batch.schema.field("file_id").type
            for file, start, end, text in zip(*(batch.column(c).to_pylist() for c in ("file_id", "start_ms", "end_ms", "text")), strict=True):
                same = last is not None and last[0] == file
                if same and None not in (start, end, last[2], last[3]) and 0 <= start - last[3] <= max_gap_ms and end - last[2] <= max_duration_ms:
                    last[3] = end
                    last[4].append(text)
                    continue
                if last is not None:
                    done.append(last)
                last = [file, last[1] + 1 if same else 1, start, end, [text]]
            if done:
                yield given()
        if last is not None:
            done.append(last)
            yield given()

    return run


def merge_fragments(cues: DataFrame, max_duration_ms: int = 4000, max_gap_ms: int = 250) -> DataFrame:
    """Join a cue to the last output cue where the gap is small and the whole stays short; renumbered per file.

    Whether a cue joins depends on the one merged before it, so the rows of a file are walked once in the order that a
    window by file gives them, in the partition where they lie; a text is not moved or held again for it.
    """
    c = cues.select("file_id", "idx", "start_ms", "end_ms", "text")
    if max_duration_ms <= 0:
        return c
    dealt = c.withColumn("at", F.row_number().over(by_idx())).sortWithinPartitions("file_id", "idx")
    kind = c.schema["file_id"].dataType.simpleString()
    return dealt.mapInArrow(_walk(max_duration_ms, max_gap_ms), f"file_id {kind}, idx int, start_ms long, end_ms long, text string")


def limits_of(profile: Mapping[str, Any], fps: float = 23.976) -> dict[str, Any]:
    """Limits for moving timecodes; here the gap in frames is rounded to whole milliseconds."""
    limits = profile.get("limits") or {}
    duration, weights = limits.get("duration_ms") or {}, limits.get("char_weights") or {}
    gap = max(limits.get("min_gap_ms") or 0, round((limits.get("min_gap_frames") or 0) * 1000.0 / fps))
    return {"least": duration.get("min"), "most": duration.get("max"), "gap": int(gap), "cps": (limits.get("reading_speed_cps") or {}).get("children" if profile.get("children") else "adult"), "wide": float(weights.get("cjk", 1.0)), "other": float(weights.get("other", 1.0))}


#: Fixed values, in frames: least and most lead before speech, after it, and what a loudness detector hears too late.
LEADS = {"loudness": ((2, 3), (6, 9), 6), "vad": ((1, 2), (3, 4), 0)}


def _heard(cues: DataFrame, speech: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Cues with the next start in their file, and where the speech that overlaps them begins (``voice``) and ends (``quiet``); the columns ``kept`` go along.

    Spans in order of their starts have a latest end so far. That of the spans which start before a cue ends is the end
    sought, if it lies behind the cue's start; and the first span with a latest end behind the cue's start is the first one
    to overlap it. So cues and spans are dealt by file once, and put in order for the one and the other.
    """
    spans = speech.filter("start_ms is not null and end_ms is not null").select("file_id", F.lit(1).alias("kind"), F.lit(None).cast(cues.schema["idx"].dataType).alias("idx"), "start_ms", "end_ms", *[F.lit(None).cast(cues.schema[c].dataType).alias(c) for c in kept])
    rows = cues.select("file_id", F.lit(0).alias("kind"), "idx", "start_ms", "end_ms", *kept).unionByName(spans).repartition("file_id")
    is_cue, so_far = F.col("kind") == 0, (Window.unboundedPreceding, 0)
    # Where they meet, the cue comes first, since spans that only touch do not overlap.
    by_reach = Window.partitionBy("file_id").orderBy(F.when(is_cue, F.col("end_ms")).otherwise(F.col("start_ms")), "kind").rowsBetween(*so_far)
    rows = rows.withColumn("latest", F.max(F.when(~is_cue, F.col("end_ms"))).over(by_reach))
    by_latest = Window.partitionBy("file_id").orderBy(F.when(is_cue, F.col("start_ms")).otherwise(F.col("latest")).desc(), "kind").rowsBetween(*so_far)
    rows = rows.withColumn("first", F.min(F.when(~is_cue, F.col("start_ms"))).over(by_latest)).filter(is_cue)
    over = F.col("latest") > F.col("start_ms")
    rows = rows.select("file_id", "idx", *[F.col(c).cast(cues.schema[c].dataType).alias(c) for c in ("start_ms", "end_ms")], F.when(over, F.col("first")).alias("voice"), F.when(over, F.col("latest")).alias("quiet"), *kept)
    return rows.withColumn("following", F.lead("start_ms").over(by_start()))


def _points(cues: DataFrame, speech: DataFrame, fps: float, tolerance_frames: int, detector: str, kept: tuple[str, ...] = ()) -> tuple[DataFrame, list[tuple[str, Column, Column]]]:
    """Rows of ``_heard``, and (field, condition, suggestion): in-points without speech, or too far from it, and out-points."""
    (low_in, lead_in), (lead_out, _), tail = LEADS[detector]
    frame = 1000.0 / fps
    near = _heard(cues, speech, kept)
    near = near.withColumn("quiet", F.when(F.col("quiet").isNotNull(), F.least("quiet", "following")))
    want_in = F.col("voice") - lead_in * frame
    want_out = F.least(F.col("quiet") + (tail + lead_out) * frame, F.col("following").cast("double"))
    far = lambda field, want: F.abs(F.col(field) - want) > tolerance_frames * frame
    points = [("start_ms", F.col("voice").isNull(), F.col("start_ms")), ("start_ms", far("start_ms", want_in), F.bround(want_in)), ("end_ms", F.col("voice").isNotNull() & far("end_ms", want_out), F.bround(want_out))]
    return near, [(field, when, to.cast("long")) for field, when, to in points]


def spotting_suggestions(cues: DataFrame, speech: DataFrame, fps: float = 23.976, tolerance_frames: int = 4, detector: str = "loudness") -> DataFrame:
    """(file_id, idx, field, current, suggested): in- and out-points that are too far from the speech below them."""
    near, points = _points(cues, speech, fps, tolerance_frames, detector)
    said = [F.when(when, F.struct(F.lit(field).alias("field"), F.col(field).alias("current"), to.alias("suggested"))) for field, when, to in points]
    return near.select("file_id", "idx", F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("s")).select("file_id", "idx", "s.*")


def spotted(cues: DataFrame, speech: DataFrame, fps: float = 23.976, tolerance_frames: int = 4, detector: str = "loudness", kept: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, idx, start_ms, end_ms, kept): cues with what is safe of their suggestions, which stay in the rows of their cues."""
    near, points = _points(cues, speech, fps, tolerance_frames, detector, kept)
    first = lambda wanted: F.coalesce(*[F.when(when, to) for field, when, to in points if field == wanted])
    return take_points(near.select("file_id", "idx", "start_ms", "end_ms", first("start_ms").alias("a"), first("end_ms").alias("b"), *kept), kept)


def shot_change_suggestions(cues: DataFrame, shots: DataFrame, fps: float = 23.976, clearance_ms: int = 500) -> DataFrame:
    """The first shot, in list order, that an edge touches (quiet) or misses by less than the clearance (snap)."""
    frame = 1000.0 / fps
    s = shots.select("file_id", "shot_ms", F.col("pos").alias("shot_pos"))
    reach = max(clearance_ms, 4 * frame)

    def side(field: str, target: Column) -> DataFrame:
        touches = F.abs(F.col(field) - target) <= frame
        near = F.abs(F.col(field) - F.col("shot_ms")) < clearance_ms
        edges = cues.select("file_id", "idx", field)
        hit = meeting(edges, s, (F.col(field), F.col(field)), (F.col("shot_ms") - reach, F.col("shot_ms") + reach)).filter(near | touches)
        first = hit.groupBy("file_id", "idx", F.col(field).alias("current")).agg(F.min(F.struct("shot_pos", touches.alias("quiet"), target.alias("target"))).alias("f"))
        return first.filter("not f.quiet").select("file_id", "idx", F.lit(field).alias("field"), "current", F.col("f.target").cast("long").alias("suggested"))

    return side("start_ms", F.col("shot_ms").cast("double")).unionByName(side("end_ms", F.bround(F.col("shot_ms") - 2 * frame)))


class _Resplitting:
    """Rows (file_id, side, idx, start_ms, end_ms, text), a file's speech (side 0) before its cues, to the pieces of the cues."""

    def __init__(self, capacity: float, wide: float, other: float, tolerance_ms: int) -> None:
        self.capacity, self.weights, self.tolerance, self.done = capacity, (wide, other), tolerance_ms, []
        self.end()

    def end(self) -> None:
        self.middles: list[tuple[int, int]] = []
        self.before, self.n, self.sorted = None, 0, False

    def take(self, row: tuple) -> None:
        file, side, idx, start, end, text = row
        if side == 0:
            # A silence lies between a span's end and the next one's start; spans come in order.
            if None not in (self.before, start):
                self.middles.append(((self.before + start) // 2, self.before))
            self.before = end
            return
        if not self.sorted:
            self.middles.sort()
            self.sorted = True
        pieces = [text]
        if text is not None and weighted(text, *self.weights) > self.capacity:
            cut = pieces_of(text, self.capacity, *self.weights)
            pieces = cut if len(cut) > 1 else pieces
        bounds = self.settled(self.laid(pieces, start, end)) if len(pieces) > 1 else [start, end]
        for i, piece in enumerate(pieces):
            self.n += 1
            self.done.append((file, self.n, idx, bounds[i], bounds[i + 1], piece))

    def laid(self, pieces: list[str], start: int | None, end: int | None) -> list[int | None]:
        """Bounds by weighted length: each is rounded before the next share is laid on it; the last piece ends with the cue."""
        if start is None or end is None:
            return [start, *[None] * (len(pieces) - 1), end]
        sizes = [max(weighted(p, *self.weights), 0.5) for p in pieces]
        total, bounds = reduce(lambda a, x: a + x, sizes), [start]  # in order, without the compensation of sum()
        for size in sizes[:-1]:
            bounds.append(round(bounds[-1] + (end - start) * size / total))
        return [*bounds, end]

    def settled(self, bounds: list[int | None]) -> list[int | None]:
        """A bound goes into its silence if that lies between the bound before, as it is by now, and the one after."""
        out = bounds[:1]
        for i, bound in enumerate(bounds[1:-1], 1):
            if bound is not None:
                first = bisect_left(self.middles, (bound - self.tolerance,))
                last = bisect_left(self.middles, (bound + self.tolerance + 1,), first)
                near = min(((abs(m - bound), a, m) for m, a in self.middles[first:last]), default=None)
                if near and out[-1] < near[2] < bounds[i + 1]:
                    bound = near[2]
            out.append(bound)
        return [*out, bounds[-1]]


def resplit_cues(cues: DataFrame, profile: Mapping[str, Any], speech: DataFrame | None = None, tolerance_ms: int = 400) -> DataFrame:
    """Cues too long for the lines they may have, cut and timed by weighted length; boundaries move into silences.

    Returns (file_id, idx, origin_idx, start_ms, end_ms, text), renumbered, with the cue each piece comes from. Speech and
    cues are walked as one, by file, the speech first: a task holds the silences of one file, and no text is dealt for them.
    """
    limits = profile.get("limits") or {}
    weights = limits.get("char_weights") or {}
    wide, other = float(weights.get("cjk", 1.0)), float(weights.get("other", 1.0))
    capacity = (limits.get("chars_per_line") or 42) * (limits.get("max_lines") or 2)
    times = [F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms")]
    rows = cues.select("file_id", F.lit(1).alias("side"), "idx", *times, "text")
    if speech is not None:
        rows = speech.select("file_id", F.lit(0).alias("side"), F.lit(None).cast(cues.schema["idx"].dataType).alias("idx"), *times, F.lit(None).cast("string").alias("text")).unionByName(rows)
    result = StructType().add("file_id", cues.schema["file_id"].dataType).add("idx", "integer").add("origin_idx", cues.schema["idx"].dataType).add("start_ms", "long").add("end_ms", "long").add("text", "string")
    return walked(rows, ["side", "idx", "start_ms", "end_ms"], lambda: _Resplitting(capacity, wide, other, tolerance_ms), result)


def carry_notes(split: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes follow their cue to all its pieces; several on one cue are joined."""
    joined = notes.groupBy("file_id", F.col("idx").alias("origin_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"]), " / ").alias("note"))
    return split.join(joined, ["file_id", "origin_idx"]).select("file_id", "idx", "note")


# Edits

PLACE_HEAD = r"^((?:\{\\an[1-9]\})?)"


def split_at(cues: DataFrame, edits: DataFrame, margin_ms: int = 100) -> DataFrame:
    """Cut cues at (file_id, idx, at_ms): text by share of time at the nearest blank to the left; renumbered."""
    joined = cues.join(edits.select("file_id", "idx", "at_ms"), ["file_id", "idx"], "left")
    inside = F.coalesce((F.col("at_ms") >= F.col("start_ms") + margin_ms) & (F.col("at_ms") <= F.col("end_ms") - margin_ms), F.lit(False))
    tag, body = F.regexp_extract("text", PLACE_HEAD, 1), F.regexp_replace("text", PLACE_HEAD, "")
    joined = joined.select("*", inside.alias("cut"), tag.alias("tag"), body.alias("body"))
    share = (F.col("at_ms") - F.col("start_ms")) / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    mark = F.greatest(F.lit(1), F.least(F.length("body") - 1, F.bround(F.length("body") * share).cast("int")))
    joined = joined.withColumn("mark", mark)
    blank = F.col("mark") + 1 - F.instr(F.reverse(F.substring(F.col("body"), F.lit(1), F.col("mark") + 1)), " ")
    joined = joined.withColumn("at", F.when(F.contains(F.substring(F.col("body"), F.lit(1), F.col("mark") + 1), F.lit(" ")) & (blank > 0), blank).otherwise(F.col("mark")))
    piece = lambda s, e, t: F.struct(F.col(s).alias("start_ms"), F.col(e).alias("end_ms"), t.alias("text"))
    first = piece("start_ms", "at_ms", F.concat("tag", trimmed(F.substring(F.col("body"), F.lit(1), F.col("at")))))
    second = piece("at_ms", "end_ms", F.concat("tag", trimmed(F.substring(F.col("body"), F.col("at") + 1, F.length("body")))))
    out = joined.select("file_id", "idx", F.posexplode(F.when(F.col("cut"), F.array(first, second)).otherwise(F.array(piece("start_ms", "end_ms", F.col("text"))))).alias("pos", "c"))
    return out.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("idx", "pos")).alias("idx"), "c.*")


def merge_with_next(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """Join the cues of (file_id, idx, as_dialogue) with the one after each; renumbered."""
    marked = cues.join(edits.select("file_id", "idx", F.lit(True).alias("joins"), "as_dialogue"), ["file_id", "idx"], "left")
    nxt = lambda c: F.lead(c).over(by_idx())
    marked = marked.select("*", nxt("end_ms").alias("next_end"), nxt("text").alias("next_text"), F.lag("joins").over(by_idx()).alias("taken"))
    first, second = F.regexp_replace("text", PLACE_HEAD, ""), F.regexp_replace("next_text", PLACE_HEAD, "")
    dash = lambda x: F.when(F.col("as_dialogue") & ~F.startswith(x, F.lit("-")), F.concat(F.lit("- "), x)).otherwise(x)
    both = F.concat(F.regexp_extract("text", PLACE_HEAD, 1), dash(first), F.lit("\n"), dash(second))
    merges = F.col("joins") & F.col("next_end").isNotNull()
    kept = marked.filter("taken is null").select("file_id", "idx", "start_ms", F.when(merges, F.col("next_end")).otherwise(F.col("end_ms")).alias("end_ms"), F.when(merges, both).otherwise(F.col("text")).alias("text"))
    return kept.select("file_id", F.row_number().over(by_idx()).alias("idx"), "start_ms", "end_ms", "text")


def set_points(cues: DataFrame, edits: DataFrame, least_ms: int = 100) -> DataFrame:
    """Move one edge of the cues in (file_id, idx, field, at_ms), unless it crosses a neighbour or leaves too little."""
    around = cues.select("*", F.lag("end_ms").over(by_idx()).alias("before"), F.lead("start_ms").over(by_idx()).alias("after"))
    joined = around.join(edits.select("file_id", "idx", "field", "at_ms"), ["file_id", "idx"], "left")
    start = (F.col("field") == "start_ms") & (F.col("at_ms") >= F.coalesce("before", F.lit(0))) & (F.col("at_ms") < F.col("end_ms") - least_ms)
    end = (F.col("field") == "end_ms") & (F.col("after").isNull() | (F.col("at_ms") <= F.col("after"))) & (F.col("at_ms") > F.col("start_ms") + least_ms)
    return joined.select("file_id", "idx", F.when(start, F.col("at_ms")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(end, F.col("at_ms")).otherwise(F.col("end_ms")).alias("end_ms"))


def toggle_dash(text: Column) -> Column:
    """Dialogue dashes on all lines, or off where all have one; the place mark stays in front."""
    lines = F.split(F.regexp_replace(text, PLACE_HEAD, ""), "\n", -1)
    blank = lambda x: trimmed(x) == ""
    all_have = F.forall(lines, lambda x: blank(x) | x.rlike(r"^\s*-"))
    put = lambda x: F.when(blank(x), x).otherwise(F.concat(F.lit("- "), F.regexp_replace(x, r"^\s+", "")))
    return F.concat(F.regexp_extract(text, PLACE_HEAD, 1), F.array_join(F.transform(lines, lambda x: F.when(all_have, F.regexp_replace(x, r"^\s*-*\s*", "")).otherwise(put(x))), "\n"))


def remove_line_breaks(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, PLACE_HEAD, ""), "\n", -1), trimmed), lambda x: x != "")
    return F.concat(F.regexp_extract(text, PLACE_HEAD, 1), F.array_join(parts, " "))


def off_recommendation(cues: DataFrame, low_ms: int | None, high_ms: int | None) -> DataFrame:
    """Cues outside the recommended duration of a genre: a list, not findings."""
    d = F.col("end_ms") - F.col("start_ms")
    off = (d < low_ms if low_ms is not None else F.lit(False)) | (d > high_ms if high_ms is not None else F.lit(False))
    return cues.select("file_id", "idx", d.alias("duration_ms")).filter(off if low_ms is not None or high_ms is not None else F.lit(False))


# Spans from sampled series


#: Samples of a series that are looked at together.
BLOCK = 4096


def _runs(on: DataFrame, least_between: int) -> DataFrame:
    """(media_id, a, b): first and last sample of each run of samples ``i`` with fewer than ``least_between`` missing in between.

    Runs are found within blocks of a series. Only the first and last sample of each block and its number of runs come
    together by series; they say whether a block's first run goes on with the run before and how the runs count on.
    """
    block = ["media_id", "block"]
    within = Window.partitionBy(*block).orderBy("i")
    apart = lambda i, was: i - was - 1 >= least_between
    on = on.select("media_id", "i", F.floor(F.col("i") / BLOCK).alias("block"))
    breaks = F.coalesce(apart(F.col("i"), F.lag("i").over(within)), F.lit(False)).cast("int")
    local = on.withColumn("breaks", breaks).withColumn("run", F.sum("breaks").over(within)).groupBy(*block, "run").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    by_block = Window.partitionBy("media_id").orderBy("block")
    sums = local.groupBy(*block).agg(F.min("a").alias("first"), F.max("b").alias("last"), F.max("run").alias("more"))
    fresh = F.coalesce(apart(F.col("first"), F.lag("last").over(by_block)), F.lit(True)).cast("int")
    sums = sums.withColumn("fresh", fresh)
    base = F.sum("fresh").over(by_block) + F.coalesce(F.sum("more").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(sums.select(*block, base.alias("base")), block).groupBy("media_id", (F.col("base") + F.col("run")).alias("g")).agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")


def activity_spans(signal: DataFrame, threshold: float = 0.5, step_ms: int = 32, least_ms: int = 120, bridge_ms: int = 250, pad_ms: int = 0) -> DataFrame:
    """(media_id, start_ms, end_ms) where p reaches the threshold; short silences are bridged, short spans dropped."""
    spans = _runs(signal.filter(F.col("p") >= threshold), -(-bridge_ms // step_ms))
    last = signal.groupBy("media_id").agg(F.max("i").alias("last"))
    out = spans.join(last, "media_id").select("media_id", (F.col("a") * step_ms).alias("start_ms"), ((F.col("b") + 1) * step_ms).alias("end_ms"), ((F.col("last") + 1) * step_ms).alias("total"))
    out = out.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    return out.select("media_id", F.greatest(F.col("start_ms") - pad_ms, F.lit(0)).alias("start_ms"), F.least(F.col("end_ms") + pad_ms, F.col("total")).alias("end_ms"))


def complement_spans(silences: DataFrame, totals: DataFrame) -> DataFrame:
    """What lies between silences up to the total; an open last silence (null end) runs to it."""
    order = Window.partitionBy("media_id").orderBy("start_ms")
    edges = silences.select("media_id", "start_ms", "end_ms").unionByName(totals.select("media_id", F.col("total_ms").alias("start_ms"), F.lit(None).cast("long").alias("end_ms")))
    spans = edges.join(totals, "media_id").select("media_id", F.coalesce(F.lag(F.coalesce("end_ms", "total_ms")).over(order), F.lit(0)).alias("a"), F.least("start_ms", "total_ms").alias("b"))
    return spans.filter("b > a").select("media_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def _upper_median(levels: DataFrame, value: str, name: str) -> DataFrame:
    """Upper median by media_id from counts k of distinct values: nothing but counts is sorted."""
    order = Window.partitionBy("media_id").orderBy(value)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = levels.filter(F.col(value).isNotNull()).withColumn("upto", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("n", F.sum("k").over(whole))
    half = F.floor(F.col("n") / 2)
    return at.filter((F.col("upto") > half) & (F.col("upto") - F.col("k") <= half)).select("media_id", F.col(value).alias(name))


def outlier_spans(signal: DataFrame, step_ms: int = 32, factor: float = 2.5) -> DataFrame:
    """Runs of samples above the upper median plus ``factor`` times the median deviation; under four samples: none."""
    levels = signal.groupBy("media_id", "p").agg(F.count("p").alias("k"), F.count("*").alias("rows"))
    mid = _upper_median(levels, "p", "mid").join(levels.groupBy("media_id").agg(F.sum("rows").alias("n")), "media_id").filter("n >= 4").drop("n")
    far = levels.join(mid, "media_id").select("media_id", "mid", F.abs(F.col("p") - F.col("mid")).alias("d"), "k")
    off = mid.join(_upper_median(far.groupBy("media_id", "d").agg(F.sum("k").alias("k")), "d", "mad"), "media_id", "left")
    high = signal.join(off, "media_id").filter(F.col("p") > F.col("mid") + factor * F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")))
    return _runs(high, 1).select("media_id", (F.col("a") * step_ms).alias("start_ms"), ((F.col("b") + 1) * step_ms).alias("end_ms"))


def waveform_peaks(signal: DataFrame, block: int = 128) -> DataFrame:
    """Least and greatest sample of each full block."""
    g = signal.groupBy("media_id", F.floor(F.col("i") / block).alias("block")).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"))
    return g.filter(F.col("n") == block).drop("n")
