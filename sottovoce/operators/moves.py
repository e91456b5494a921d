"""Timecodes moved in order, where a cue may depend on the cue before as that stands by then.

A cue depends on the one before only in one rule. Windows decide everything else, cut each file into runs of cues
that hang together, and only within a run the value that passes on is folded; a run is a few cues long.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sottovoce.functions.text import one_decimal, weighted_chars


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once."""
    return F.get(F.transform(F.array(value), use), 0)


def carried(rows: DataFrame, hangs: Column, passes_on: Callable[[Column, Column], Column], as_: str) -> DataFrame:
    """``rows`` (file_id, pos, ...) with what the row before passes on; null before a row that does not hang on it.

    ``passes_on(row, carried)`` gives a long from a row and from what was carried to it.
    """
    order = Window.partitionBy("file_id").orderBy("pos")
    known = rows.withColumn("hangs", F.coalesce(hangs, F.lit(False)) & (F.col("pos") > 1))
    known = known.withColumn("run", F.sum((~F.col("hangs")).cast("long")).over(order))
    runs = known.groupBy("file_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rows.columns if c not in ("file_id", "pos")]))).alias("rows"))
    none = F.lit(None).cast("long")
    start = F.struct(F.array().cast("array<bigint>").alias("each"), none.alias("last"))
    fold = F.aggregate(F.slice("rows", 1, F.size("rows") - 1), start, lambda acc, x: let(passes_on(x, acc["last"]), lambda v: F.struct(F.concat(acc["each"], F.array(v)).alias("each"), v.alias("last"))), lambda acc: acc["each"])
    each = F.when(F.size("rows") > 1, F.concat(F.array(none), fold)).otherwise(F.array(none))
    out = runs.select("file_id", F.explode(F.arrays_zip("rows", each.alias("each"))).alias("z"))
    return out.select("file_id", "z.rows.*", F.col("z.each").alias(as_))


CHANGE = "struct<field:string,before:bigint,after:bigint,reason:string>"


class _Round:
    """One round of the rules over (file_id, pos, idx, s, e, chars, log)."""

    def __init__(self, limits: Mapping[str, Any], kept: tuple[str, ...] = ()) -> None:
        self.kept = kept
        self.least, self.most, self.gap, self.cps = (limits[k] for k in ("least", "most", "gap", "cps"))

    def spaced(self, s: Column, e: Column, edge: Column) -> Column:
        """The gap before the next cue, if the cue stays long enough."""
        if not self.gap:
            return e
        close = (edge < e) & (e <= edge + self.gap)
        return F.when(close & (edge - s >= self.least if self.least else F.lit(True)), edge).otherwise(e)

    def capped(self, s: Column, e: Column) -> Column:
        return F.least(e, s + self.most) if self.most else e

    def readable(self, s: Column, e: Column, edge: Column, chars: Column) -> Column:
        """Time to read, as far as the next cue and the longest duration leave it."""
        if not self.cps:
            return e
        fast = (e <= s) | (chars / ((e - s) / 1000.0) > self.cps)
        bounds = [s + chars * 1000 / self.cps, *([(s + self.most).cast("double")] if self.most else []), edge.cast("double")]
        want = F.least(*bounds)
        return F.when(fast & (want > e), F.rint(want).cast("long")).otherwise(e)

    def pulled(self, carried_end: Column, cut: Column, edge: Column) -> Column:
        """The in-point that makes room for the least duration, or null if the cue before does not leave it."""
        start = F.greatest(F.coalesce(carried_end + self.gap, F.lit(0)), cut - self.least)
        return F.when(edge - start >= self.least, start)

    def end_of(self, x: Column, carried_end: Column) -> Column:
        """Where a cue ends after this round, given the end of the cue before."""
        start = F.when(x["squeezed"], self.pulled(carried_end, x["cut"], x["edge"]))
        timed = let(start, lambda p: F.struct(F.coalesce(p, x["s"]).alias("s"), F.when(p.isNotNull(), x["edge"]).otherwise(x["held"]).alias("e")))
        return let(timed, lambda t: let(self.capped(t["s"], self.spaced(t["s"], t["e"], x["edge"])), lambda e: self.readable(t["s"], e, x["edge"], x["chars"])))

    def __call__(self, cues: DataFrame) -> DataFrame:
        order = Window.partitionBy("file_id").orderBy("pos")
        edge = F.lead("s").over(order) - self.gap
        c = cues.withColumns({"edge": edge, "next_idx": F.lead("idx").over(order)})
        c = c.withColumn("cut", F.when(F.col("e") > F.col("edge") + self.gap, F.col("edge")).otherwise(F.col("e")))
        if self.least:
            short = F.col("cut") - F.col("s") < self.least
            blocked = F.coalesce(F.col("s") + self.least > F.col("edge"), F.lit(False))
            c = c.withColumns({"held": F.when(short & ~blocked, F.col("s") + self.least).otherwise(F.col("cut")), "squeezed": short & blocked})
            c = carried(c, F.col("squeezed"), self.end_of, "before_end")
            c = c.withColumn("pull", F.when(F.col("squeezed"), self.pulled(F.col("before_end"), F.col("cut"), F.col("edge"))))
            c = c.withColumns({"s1": F.coalesce("pull", "s"), "e1": F.when(F.col("pull").isNotNull(), F.col("edge")).otherwise(F.col("held"))})
        else:
            c = c.withColumns({"s1": F.col("s"), "e1": F.col("cut")})
        c = c.withColumn("e2", self.spaced(F.col("s1"), F.col("e1"), F.col("edge")))
        c = c.withColumn("e3", self.capped(F.col("s1"), F.col("e2")))
        c = c.withColumn("e4", self.readable(F.col("s1"), F.col("e3"), F.col("edge"), F.col("chars")))
        return c.select("file_id", "pos", "idx", F.col("s1").alias("s"), F.col("e4").alias("e"), "chars", F.concat("log", self.changes()).alias("log"), *self.kept)

    def changes(self) -> Column:
        def change(field: str, before: str, after: str, reason: Column | str) -> Column:
            said = F.struct(F.lit(field).alias("field"), F.col(before).alias("before"), F.col(after).alias("after"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
            return F.when(F.col(before) != F.col(after), said.cast(CHANGE))

        overlap = F.concat(F.lit("다음 자막(#"), F.col("next_idx").cast("string"), F.lit(")과 겹쳐 아웃점을 당김"))
        made = [
            change("end_ms", "e", "cut", overlap),
            change("start_ms", "s", "s1", "최소 표시 시간 확보(인점 당김)"),
            change("end_ms", "cut", "e1", "최소 표시 시간 확보"),
            change("end_ms", "e1", "e2", f"자막 간 간격 {self.gap}ms 확보"),
            change("end_ms", "e2", "e3", "최대 표시 시간 초과"),
            change("end_ms", "e3", "e4", "읽기 속도 확보"),
        ]
        return F.filter(F.array(*made), lambda x: x.isNotNull())

    def unresolved(self) -> Column:
        """Reasons why a cue (s, e, chars, next_s, next_idx) is still out of the limits."""
        length = F.col("e") - F.col("s")
        out = [F.when(F.col("e") > F.col("next_s"), F.concat(F.lit("다음 자막(#"), F.col("next_idx").cast("string"), F.lit(")과 여전히 겹칩니다")))]
        if self.least:
            out.append(F.when(length < self.least, F.concat(F.lit(f"최소 표시 시간 {self.least}ms를 확보하지 못했습니다(현재 "), length.cast("string"), F.lit("ms) — 앞뒤 자막과 병합을 검토하세요"))))
        if self.cps:
            speed = F.when(length > 0, F.col("chars") / (length / 1000.0)).otherwise(F.lit(float("inf")))
            out.append(F.when(speed > self.cps, F.concat(F.lit("읽기 속도 "), one_decimal(speed), F.lit(" CPS — 시간으로는 더 못 줄입니다. 글자를 줄이거나 자막을 나누세요"))))
        return F.filter(F.array(*out), lambda x: x.isNotNull())


def converge(cues: DataFrame, limits: Mapping[str, Any], rounds: int = 3, kept: tuple[str, ...] = ()) -> DataFrame:
    """Cues moved into the limits, the changes made, and what stays unresolved: one table, told apart by ``kind``.

    A round that changes nothing would change nothing again, so the rounds are simply laid one on the other. A cue
    hangs on the cue before only where it is too short and has no room after it. The columns ``kept`` go along.
    """
    run = _Round(limits, kept)
    order = Window.partitionBy("file_id").orderBy("pos")
    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms", "idx"))
    none = F.array().cast(f"array<{CHANGE}>")
    c = cues.select("file_id", pos.alias("pos"), "idx", F.col("start_ms").cast("long").alias("s"), F.col("end_ms").cast("long").alias("e"), weighted_chars(F.col("text"), limits["wide"], limits["other"]).alias("chars"), none.alias("log"), *kept)
    for _ in range(rounds):
        c = run(c)
    c = c.withColumns({"next_s": F.lead("s").over(order), "next_idx": F.lead("idx").over(order)})
    fields = "kind string, start_ms bigint, end_ms bigint, field string, before bigint, after bigint, reason string"
    row = "struct<" + fields.replace(" ", ":", 1).replace(", ", ",").replace(" ", ":") + ">"
    no = F.lit(None)
    moved = F.transform("log", lambda x: F.struct(F.lit("change"), no, no, x["field"], x["before"], x["after"], x["reason"]).cast(row))
    left = F.transform(run.unresolved(), lambda x: F.struct(F.lit("unresolved"), no, no, no, no, no, x).cast(row))
    own = F.array(F.struct(F.lit("cue"), F.col("s"), F.col("e"), no, no, no, no).cast(row))
    return c.select("file_id", "idx", *kept, F.explode(F.concat(own, moved, left)).alias("r")).select("file_id", "r.kind", "idx", "r.start_ms", "r.end_ms", "r.field", "r.before", "r.after", "r.reason", *kept)


def apply_spotting(cues: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggestions in the order of cue starts, each taken only if it does not cross a neighbour as that stands by then.

    An out-point is taken if it lies after the cue's own in-point and not after the next cue's. Only where the old
    and the suggested in-point disagree about that does a cue hang on the end of the cue before.
    """
    want = suggestions.groupBy("file_id", "idx").agg(F.max(F.when(F.col("field") == "start_ms", F.col("suggested"))).alias("a"), F.max(F.when(F.col("field") == "end_ms", F.col("suggested"))).alias("b"))
    return take_points(cues.select("file_id", "idx", "start_ms", "end_ms").join(want, ["file_id", "idx"], "left"))


def take_points(cues: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """``apply_spotting`` for cues that bear their suggested in-point ``a`` and out-point ``b``; the columns ``kept`` go along."""
    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms", "idx"))
    c = cues.select("file_id", "idx", F.col("start_ms").cast("long").alias("s"), F.col("end_ms").cast("long").alias("e"), pos.alias("pos"), "a", "b", *kept)
    order = Window.partitionBy("file_id").orderBy("pos")
    c = c.withColumns({"room": F.coalesce(F.lead("s").over(order), F.col("b")), "old_end": F.lag("e").over(order)})

    def start(x: Callable[[str], Column], before: Column) -> Column:
        return F.when((F.coalesce(before, F.lit(0)) <= x("a")) & (x("a") < x("e")), x("a")).otherwise(x("s"))

    def end(x: Callable[[str], Column], s: Column) -> Column:
        return F.when((s < x("b")) & (x("b") <= x("room")), x("b")).otherwise(x("e"))

    disagree = (F.col("s") < F.col("b")) != (F.col("a") < F.col("b"))
    c = c.withColumn("open", F.coalesce(disagree & (F.col("b") <= F.col("room")), F.lit(False)))
    c = carried(c, F.col("open"), lambda x, before: let(start(lambda n: x[n], F.coalesce(before, x["old_end"])), lambda s: end(lambda n: x[n], s)), "before_end")
    c = c.withColumn("new_end", end(F.col, F.when(F.col("open"), start(F.col, F.col("before_end"))).otherwise(F.col("s"))))
    return c.select("file_id", "idx", start(F.col, F.lag("new_end").over(order)).alias("start_ms"), F.col("new_end").alias("end_ms"), *kept)
