"""Registered queries of the track operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.functions.text import TAGS
from sottovoce.operators import tracks
from sottovoce.plans.check_queries import wc
from sottovoce.sources.fixtures import CUES_B_SQL, CUES_SQL, cues, second_track

LIMITS = {"duration_ms": {"min": 833, "max": 7000}, "max_lines": 1, "chars_per_line": 42}


def pair_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return tracks.pair_tracks(c, second_track(c))


def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.pair_summary(pair_tracks(spark, sf_dir)).drop("listed")


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return tracks.match_candidates(c, second_track(c)).select("file_id", "o_idx", "t_idx")


def match_to_reference_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return tracks.match_to_reference_track(c, second_track(c))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    b = second_track(c).select("file_id", F.col("idx").alias("idx"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    return c.join(b, ["file_id", "idx"]).select("file_id", "idx", (F.col("start_ms") - F.col("s2")).alias("start_diff"), (F.col("end_ms") - F.col("e2")).alias("end_diff"))


def timing_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.timing_error_stats(_diffs(spark, sf_dir))


def worst_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.worst_matches(_diffs(spark, sf_dir))


def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_stats(cues(spark, sf_dir), 1.0, 0.5)


def track_flags_by_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_flags(cues(spark, sf_dir), LIMITS).withColumn("kinds", F.array_join("kinds", ","))


def track_flags_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_flags(cues(spark, sf_dir)).withColumn("kinds", F.array_join("kinds", ","))


def profile_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = F.when(F.col("idx") % 6 == 0, F.concat(F.lit("{\\an8}"), "text")).otherwise(F.col("text"))
    return tracks.profile_evidence(cues(spark, sf_dir).withColumn("text", placed))


def bare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select("file_id", "idx", tracks.bare_text(F.col("text")).alias("bare"))


def align_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues on the lines of the coarser track: every second cue finds no line, some lines have lost words, and some have no cue."""
    c = cues(spark, sf_dir)
    fewer = F.array_join(F.filter(F.split("text", " "), lambda w, k: k % 3 != 2), " ")
    said = F.when(F.col("idx") % 4 == 0, fewer).when(F.col("idx") % 17 == 5, "이 줄은 말하지 않습니다").otherwise(F.col("text"))
    return tracks.align_transcript(c, second_track(c).select("file_id", F.col("idx").alias("pos"), said.alias("text")))


def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.alignment_summary(align_transcript(spark, sf_dir))


QUERIES = {f.__name__: f for f in (pair_tracks, pair_summary, match_candidates, match_to_reference_track, timing_error_stats, worst_matches, track_stats, track_flags_by_limits, track_flags_by_track, profile_evidence, bare_text, align_transcript, alignment_summary)}

_PAIRS = f"""with {CUES_SQL}, {CUES_B_SQL}, u as (select file_id, start_ms, end_ms, text, idx, 0 as side, end_ms <= start_ms as flat from cues union all select file_id, start_ms, end_ms, text, idx, 1, end_ms <= start_ms from cues_b),
r as (select *, max(end_ms) over (partition by file_id, flat order by start_ms, side, idx rows between unbounded preceding and 1 preceding) as reach from u),
g as (select *, sum(case when reach is null or start_ms >= reach or flat then 1 else 0 end) over (partition by file_id, flat order by start_ms, side, idx rows unbounded preceding) as g from r),
pr as (select file_id, min(start_ms) as start_ms, max(end_ms) as end_ms, coalesce(string_agg(text, chr(10) order by start_ms, idx) filter (side = 0), '') as source, coalesce(string_agg(text, chr(10) order by start_ms, idx) filter (side = 1), '') as target, count(*) filter (side = 0) as n_source, count(*) filter (side = 1) as n_target from g group by file_id, flat, g)"""
_DIFF = f"with {CUES_SQL}, {CUES_B_SQL}, df as (select c.file_id, c.idx, c.start_ms - b.start_ms as start_diff, c.end_ms - b.end_ms as end_diff from cues c join cues_b b on c.file_id = b.file_id and c.idx = b.idx)"
_BARE = rf"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '{TAGS}', '', 'g'), chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^[\[(][^\])]{{0,20}}[\])]\s*', ''), '^-\s*', ''))), chr(10)), '^\s+|\s+$', '', 'g')"


def _measured(size: Callable[[str], str]) -> str:
    return f"""with {CUES_SQL}, m0 as (select *, {_BARE} as bare, end_ms - start_ms as dur, lead(start_ms) over (partition by file_id order by idx) - end_ms as gap from cues),
m1 as (select *, list_filter(string_split(bare, chr(10)), lambda x: trim(x) <> '') as ls from m0),
m as (select *, list_max(list_transform(ls, lambda x: {size('x')})) as longest, case when len(ls) > 0 then len(ls) end as n_lines, case when bare <> '' and dur <> 0 then case when dur < 0 then 'inf'::double else {size('text')} / (dur / 1000.0) end end as cps from m1)"""


def _q(values: str, p: int) -> str:
    s = f"list_sort({values})"
    n = f"len({values})"
    j = f"greatest(1, least({n} - 1, ({p} * ({n} + 1)) // 100))"
    d = f"({p} * ({n} + 1) - {j} * 100)"
    return f"case when {n} > 2 then ({s}[{j}] * (100 - {d}) + {s}[{j} + 1] * {d}) / 100 end"


def _one(x: str) -> str:
    return f"length(regexp_replace({x}, '{TAGS}|[\\r\\n]', '', 'g'))::double"


def _flags(off: str, kind: str, join: str = "") -> str:
    return f"""select m.file_id, idx, array_to_string(list_sort(list_filter([case when {off} then '{kind}' end, case when bare = '' or dur <= 0 or (length(text) - length(replace(text, '<i>', ''))) / 3 <> (length(text) - length(replace(text, '</i>', ''))) / 4 or coalesce(gap < 0, false) then '오류' end], lambda x: x is not null)), ',') as kinds from m {join}"""


def _spread(c: str) -> str:
    return f"round_even(list_sort(list(abs({c} - m{c})))[count(*) // 2 + 1], 0)::bigint as {c}_spread, arg_max({c}, abs({c}) * 100000 - idx) as {c}_worst, count(*) filter (abs({c}) <= 100) as {c}_near, round_even(any_value(m{c}), 0)::bigint as {c}_median, round_even(any_value(m{c}) / (1000.0::double / 23.976), 1) + 0.0::double as {c}_frames"


ORACLE = {
    "pair_tracks": f"{_PAIRS} select * from pr",
    "pair_summary": f"{_PAIRS} select file_id, count(*) filter (n_source > 0 and n_target > 0) as both, count(*) filter (n_target = 0) as source_only, count(*) filter (n_source = 0) as target_only, count(*) filter (n_source > 1 or n_target > 1) as merged from pr group by 1",
    "match_candidates": f"with {CUES_SQL}, {CUES_B_SQL} select a.file_id, a.idx as o_idx, b.idx as t_idx from cues a join cues_b b on a.file_id = b.file_id and a.end_ms >= b.start_ms - 2000 and a.start_ms <= b.end_ms + 2000",
    "timing_error_stats": f"{_DIFF}, md as (select *, median(start_diff) over (partition by file_id) as mstart_diff, median(end_diff) over (partition by file_id) as mend_diff from df) select file_id, count(*) as matched, {_spread('start_diff')}, {_spread('end_diff')} from md group by file_id",
    "worst_matches": f"{_DIFF}, w as (select *, abs(start_diff) + abs(end_diff) as off, row_number() over (partition by file_id order by abs(start_diff) + abs(end_diff) desc, idx)::int as rank from df) select * from w where rank <= 12",
    "track_stats": f"{_measured(wc)}, a as (select file_id, count(*) as cues, min(dur) as dur_min, max(dur) as dur_max, median(dur)::double as dur_median, median(longest) as longest_median, max(longest) as chars_max, round_even(median(cps), 1) as cps_median, count(*) filter (n_lines = 1) as lines_1, count(*) filter (n_lines = 2) as lines_2, count(*) filter (n_lines > 2) as lines_3, median(gap)::double as gap_median, list(dur::double) as ld, list(longest) filter (longest is not null) as ll, list(cps) filter (cps is not null) as lc, coalesce(list(gap::double) filter (gap is not null), []) as lg from m group by 1) select * exclude (ld, ll, lc, lg), round_even({_q('ld', 5)}, 1) as dur_p5, round_even({_q('ld', 95)}, 1) as dur_p95, round_even({_q('ll', 95)}, 1) as longest_p95, round_even({_q('lc', 95)}, 1) as cps_p95, round_even({_q('lg', 5)}, 1) as gap_p5 from a",
    "track_flags_by_limits": f"{_measured(_one)}, f as ({_flags('(dur > 0 and dur < 833) or dur > 7000 or coalesce(n_lines > 1, false) or coalesce(longest > 42, false)', '규정')}) select * from f where kinds <> ''",
    "track_flags_by_track": f"{_measured(_one)}, o as (select file_id, list(cps) filter (dur > 0 and cps is not null) as c, list(dur::double) filter (dur > 0) as d from m group by 1), ow as (select file_id, case when len(c) > 20 then {_q('c', 99)} end as high, case when len(d) > 20 then {_q('d', 1)} end as low from o), f as ({_flags('coalesce(cps > high and dur > 0, false) or coalesce(dur > 0 and dur < low, false)', '이상치', 'join ow on m.file_id = ow.file_id')}) select * from f where kinds <> ''",
    "profile_evidence": f"""with {CUES_SQL}, p as (select file_id, case when idx % 6 = 0 then '{{\\an8}}' || text else text end as text from cues), t as (select *, {_BARE} as t from p),
        e as (select file_id, 'an8' as evidence from t where contains(text, '{{\\an8}}') union all select file_id, case when starts_with(t, '''') and ends_with(t, '''') and length(t) > 1 then '작은따옴표' when starts_with(t, '"') and ends_with(t, '"') and length(t) > 1 then '큰따옴표' when starts_with(t, '[') and ends_with(t, ']') then '대괄호' when contains(text, '<i>') then '이탤릭만' end from t) select file_id, evidence, count(*) as n from e where evidence is not null group by 1, 2""",
    "bare_text": f"with {CUES_SQL} select file_id, idx, {_BARE} as bare from cues",
}
