"""Checks that look at a whole file, overlaps and screen positions, speakers and forms of address.

All are windows, joins and aggregations keyed by file.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sottovoce.functions.grams import HEADS, head_key, keys_in
from sottovoce.functions.text import SPEAKER_HEAD, formality_level, strip_tags, topic_particle, trimmed
from sottovoce.operators.near import meeting

FRAME = 1000.0 / 23.976


def _found(df: DataFrame, detail: Column, line_no: Column | None = None) -> DataFrame:
    return df.select("file_id", "idx", (line_no if line_no is not None else F.lit(None)).cast("int").alias("line_no"), detail.alias("detail"))


def gaps(cues: DataFrame) -> DataFrame:
    """Each cue with the time to the one before it by start; negative is an overlap."""
    before = F.lag("end_ms").over(Window.partitionBy("file_id").orderBy("start_ms", "idx"))
    return cues.withColumn("gap_ms", F.col("start_ms") - before)


def gap_too_short(cues: DataFrame, profile: Mapping[str, Any], fps: float = 23.976) -> DataFrame:
    """The bound in frames is not rounded here."""
    limits = profile.get("limits") or {}
    least = float(limits.get("min_gap_ms") or 0)
    if frames := limits.get("min_gap_frames"):
        least = max(least, frames * 1000.0 / fps)
    short = gaps(cues).filter((F.col("gap_ms") < least) & F.lit(least > 0))
    return _found(short, F.when(F.col("gap_ms") < 0, F.concat(F.lit("앞 자막과 "), -F.col("gap_ms"), F.lit("ms 겹칩니다"))).otherwise(F.concat(F.lit("간격 "), F.col("gap_ms"), F.lit(f"ms — 최소 {least:.0f}ms"))))


def first_event_at_zero(cues: DataFrame) -> DataFrame:
    first = cues.groupBy("file_id").agg(F.min(F.struct("start_ms", "idx")).alias("f")).filter("f.start_ms <= 0")
    return _found(first.select("file_id", F.col("f.idx").alias("idx")), F.lit("첫 자막 인점을 00:00:00:00으로 두지 않습니다"))


def ellipsis_style_inconsistent(cues: DataFrame) -> DataFrame:
    plain = cues.withColumn("p", strip_tags(F.col("text")))
    one, three = F.contains("p", F.lit("…")), F.contains("p", F.lit("..."))
    by_file = plain.groupBy("file_id").agg(F.count_if(one).alias("n1"), F.count_if(three).alias("n3"), F.min(F.when(one | three, F.col("idx"))).alias("idx")).filter("n1 > 0 and n3 > 0")
    return _found(by_file, F.format_string("전각 %d건, 점 셋 %d건이 섞였습니다 — 한쪽으로 통일합니다", "n1", "n3"))


def speaker_lines(cues: DataFrame) -> DataFrame:
    """(file_id, idx, line_no, label, said): a bracket at the head of a line with dialogue after it."""
    # Only what holds a bracket is taken apart.
    lines = cues.filter(F.contains("text", F.lit("["))).select("file_id", "idx", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.contains("line", F.lit("["))).withColumn("s", strip_tags(F.col("line")))
    out = lines.select("file_id", "idx", (F.col("pos") + 1).alias("line_no"), trimmed(F.regexp_extract("s", SPEAKER_HEAD, 1)).alias("label"), trimmed(F.regexp_extract("s", SPEAKER_HEAD, 2)).alias("said"))
    return out.filter((F.col("said") != "") & (F.col("label") != ""))


def speaker_id_inconsistent(cues: DataFrame) -> DataFrame:
    """Labels that differ only in blanks, and labels that contain another; each pair once, at the later first appearance."""
    first = speaker_lines(cues).groupBy("file_id", "label").agg(F.min(F.struct("idx", "line_no")).alias("at"))
    same = first.withColumn("bare", F.replace("label", F.lit(" "), F.lit(""))).groupBy("file_id", "bare").agg(F.array_sort(F.collect_list(F.struct("label", "at"))).alias("all")).filter(F.size("all") > 1)
    last = F.element_at("all", -1)
    spelled = same.select("file_id", last["at"]["idx"].alias("idx"), last["at"]["line_no"].alias("line_no"), F.concat(F.lit("같은 이름을 다르게 적었습니다: "), F.array_join(F.transform("all", lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))), " / ")).alias("detail"))
    base = first.withColumn("base", F.replace(F.regexp_replace("label", r"\s*\d+$", ""), F.lit(" "), F.lit(""))).filter("base <> ''")
    # Distinct names meet by the head of the shorter one; their labels follow.
    bases = base.select("file_id", "base").distinct()
    inner = bases.select("file_id", F.col("base").alias("inner"), head_key(F.col("base")).alias("key"))
    outer = bases.select("file_id", F.col("base").alias("outer"), F.explode(keys_in(F.col("base"), list(HEADS))).alias("key"))
    within = inner.join(outer, ["file_id", "key"]).filter((F.col("inner") != F.col("outer")) & F.contains("outer", F.col("inner"))).drop("key")
    named = lambda side: base.select("file_id", F.col("base").alias(side), F.struct("at", "label").alias(f"{side}_is"))
    pairs = within.join(named("inner"), ["file_id", "inner"]).join(named("outer"), ["file_id", "outer"])
    pairs = pairs.select("file_id", F.least("inner_is", "outer_is").alias("a"), F.greatest("inner_is", "outer_is").alias("b"))
    contained = pairs.select("file_id", F.col("b.at.idx").alias("idx"), F.col("b.at.line_no").alias("line_no"), F.concat(F.lit("["), "a.label", F.lit("]와 ["), "b.label", F.lit("]가 같은 인물이면 하나로 통일해야 합니다 (전개상 의도적 변경이면 그대로 두세요)")).alias("detail"))
    return spelled.unionByName(contained)


def formality_inconsistent(cues: DataFrame, cast: DataFrame | None) -> DataFrame | None:
    """Lines of a speaker whose certain level is not the one the cast sheet names; None (skipped) without a sheet."""
    if cast is None:
        return None
    lines = speaker_lines(cues).withColumn("got", formality_level(F.col("said")))
    off = lines.join(cast.filter("tone is not null and tone <> ''"), lines["label"] == cast["speaker"]).filter("got <> tone")
    return _found(off, F.concat("label", topic_particle(F.col("label")), F.lit(" "), "tone", F.lit("로 정했는데 "), "got", F.lit("입니다")), F.col("line_no"))


def formality_summary(cues: DataFrame) -> DataFrame:
    """Levels by file; the ratio is over decided lines alone and null without one."""
    plain = F.regexp_replace(strip_tags(F.col("text")), r"[\[(][^)\]]*[\])]|\{[^}]*\}|♪", "")
    said = cues.select("file_id", "idx", formality_level(F.col("text")).alias("level"), F.regexp_replace(plain, r"""[\s.,!?…"'’”」』〉》~\-]+""", "").alias("rest"))
    formal, polite = F.col("level") == "합니다체", F.col("level") == "해요체"
    out = said.groupBy("file_id").agg(F.count_if(formal).alias("formal"), F.count_if(polite).alias("polite"), F.count_if(F.col("level").isNull() & (F.col("rest") != "")).alias("undecided"), F.array_sort(F.collect_list(F.when(polite, F.col("idx")))).alias("polite_idx"))
    return out.withColumn("formal_ratio", F.when(F.col("formal") + F.col("polite") > 0, F.col("formal") / (F.col("formal") + F.col("polite"))))


def overlap_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (file_id, a_idx, b_idx) that share time within a file."""
    x, y = (d.select("file_id", *[F.col(c).alias(f"{n}_{c}") for c in ("idx", "start_ms", "end_ms")]) for d, n in ((a, "a"), (b, "b")))
    met = meeting(x, y, (F.col("a_start_ms"), F.col("a_end_ms")), (F.col("b_start_ms"), F.col("b_end_ms")))
    return met.filter("a_start_ms < b_end_ms and b_start_ms < a_end_ms").select("file_id", "a_idx", "b_idx")


# Positions on the screen

#: Places by name, and the mark that puts a cue there.
PLACES = {"top_left": 7, "top_center": 8, "top_right": 9, "bottom_left": 1, "bottom_center": 2, "bottom_right": 3}
PLACE_NAMES = {"top_left": "좌측 상단", "top_center": "상단 중앙", "top_right": "우측 상단", "bottom_left": "좌측 하단", "bottom_center": "중앙 하단", "bottom_right": "우측 하단"}
PLACE = r"\{\\an([1-9])\}"


def job_rules(profile: Mapping[str, Any], job: Mapping[str, Any] | None = None) -> dict[str, str]:
    """Marker, policy and target of this job: the job's own, else the profile's, else ``ask``."""
    narrative, collision = profile.get("forced_narrative") or {}, profile.get("collision") or {}
    marker = narrative.get("marker") or ("double_quote" if narrative.get("quote_style") == "double" else None)
    own = {"marker": marker, "policy": collision.get("policy"), "move_to": collision.get("move_to")} | {k: v for k, v in (job or {}).items() if v}
    return {"marker": own["marker"] or "ask", "policy": own["policy"] or "ask", "move_to": own["move_to"] or "top_center"}


def is_forced_narrative(text: Column, marker: str) -> Column:
    body = trimmed(F.regexp_replace(text, PLACE, ""))
    # Most texts lack the mark; those are not looked at more closely.
    holds = lambda mark: F.contains(text, F.lit(mark))
    if marker == "double_quote":
        return (holds("“") & body.rlike("(?s)^“.*”$")) | (holds('"') & body.rlike('(?s)^".*"$') & (F.length(body) > 2))
    if marker == "italic":
        return holds("<") & body.rlike("(?is)^<i>[^<]*</i>$")
    if marker == "bracket":
        return holds("[") & body.rlike(r"(?s)^\[[^\]]+\]$")
    return F.lit(False)


def set_place(text: Column, tag: Column) -> Column:
    """Swap the place mark; it stands once, at the head."""
    return F.concat(tag, F.regexp_replace(F.regexp_replace(text, PLACE, ""), r"(?U)^\s+", ""))


def position_suggestions(cues: DataFrame, rules: Mapping[str, str], busy: DataFrame | None = None) -> DataFrame:
    """(file_id, idx, reason, certain, tag, action) for dialogue that meets on-screen text, or no longer does.

    Nothing is suggested until marker and policy are decided.
    """
    marker, policy, to = rules["marker"], rules["policy"], rules["move_to"]
    decided = marker != "ask" and policy != "ask"
    # Of a text only its place goes on, so no text is shuffled.
    place = F.when(F.contains("text", F.lit("{")), F.regexp_extract("text", PLACE, 1)).otherwise(F.when(F.col("text").isNotNull(), ""))
    marked = cues.select("file_id", "idx", "start_ms", "end_ms", is_forced_narrative(F.col("text"), marker).alias("narrative"), place.alias("place")).filter(F.lit(decided))
    spoken, shown = marked.filter(~F.col("narrative")), marked.filter("narrative")
    first = overlap_join(spoken, shown).groupBy("file_id", F.col("a_idx").alias("idx")).agg(F.min("b_idx").alias("hit"))
    joined = spoken.join(first, ["file_id", "idx"], "left")
    if busy is None:
        joined = joined.withColumn("busy", F.lit(False))
    else:
        b = busy.select("file_id", F.col("start_ms").alias("bs"), F.col("end_ms").alias("be"))
        met = meeting(spoken.select("file_id", "idx", "start_ms", "end_ms"), b, (F.col("start_ms"), F.col("end_ms")), (F.col("bs"), F.col("be")))
        seen = met.filter("bs < end_ms and start_ms < be").select("file_id", "idx").distinct().withColumn("busy", F.lit(True))
        joined = joined.join(seen, ["file_id", "idx"], "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    place = F.col("place")
    tag, where = f"{{\\an{PLACES[to]}}}", PLACE_NAMES[to]

    def said(idx: Column, reason: Column, certain: bool, tag: str, action: str) -> Column:
        return F.struct(idx.alias("idx"), reason.alias("reason"), F.lit(certain).alias("certain"), F.lit(tag).alias("tag"), F.lit(action).alias("action"))

    n = F.col("hit").isNotNull()
    review = said(F.col("hit"), F.concat(F.lit("말자막("), F.col("idx"), F.lit("번)과 겹칩니다 — 이 작업 기준에서는 말자막이 우선이라 화면자막을 넣지 않습니다")), True, "", "review")
    move = said(F.col("idx"), F.concat(F.lit("화면자막("), F.col("hit"), F.lit(f"번)과 겹칩니다 — 말자막을 {where}으로")), True, tag, "move")
    maybe = said(F.col("idx"), F.lit(f"영상 아래쪽에 글자가 있어 보입니다 — 확인 후 {where}으로 옮기세요"), False, tag, "move")
    back = said(F.col("idx"), F.lit("겹치는 화면자막이 없습니다 — 기본 자리로 되돌립니다"), True, "", "reset")
    chosen = F.when(n & F.lit(policy == "dialogue_only"), review).when(n & F.lit(policy == "move_dialogue") & (place != str(PLACES[to])), move).when(~n & F.col("busy") & F.lit(policy != "keep_both") & (place == ""), maybe).when(~n & ~F.col("busy") & F.lit(policy == "move_dialogue") & (place != ""), back)
    return joined.select("file_id", chosen.alias("s")).filter("s is not null").select("file_id", "s.*")


def apply_positions(cues: DataFrame, suggestions: DataFrame, only_certain: bool = True) -> DataFrame:
    """Cues with the moves made; reviews never are."""
    made = suggestions.filter((F.col("action") != "review") & (F.col("certain") | F.lit(not only_certain))).groupBy("file_id", "idx").agg(F.max("tag").alias("tag"))
    joined = cues.join(made, ["file_id", "idx"], "left")
    return joined.withColumn("text", F.when(F.col("tag").isNotNull(), set_place(F.col("text"), F.col("tag"))).otherwise(F.col("text"))).drop("tag")


def position_collides_with_forced_narrative(cues: DataFrame, rules: Mapping[str, str], busy: DataFrame | None = None) -> DataFrame:
    return _found(position_suggestions(cues, rules, busy).filter("certain"), F.col("reason"))
