"""Registered queries of proofreading, names, summaries and the jobs on them, with SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.operators import language, names, proofread, timing
from sottovoce.plans import jobs, language_queries
from sottovoce.plans.profiles import FULL, GENRES, recommended_ms, with_genre
from sottovoce.plans.timing_queries import ORACLE as TIMING_SQL
from sottovoce.sources.fixtures import CUES_SQL, SHOTS_SQL, SPEECH_SQL, cues, dialogue, shots, speech


def _corrector(texts: list[str]) -> tuple[list[str], list[dict[str, Any]]]:
    """A corrector by rule: two blanks become one, an ellipsis of dots is flagged."""
    flags = [{"line_index": i, "reason": "말줄임표", "suggested_fix": "…" if i else "", "original_text": t} for i, t in enumerate(texts, 1) if "..." in t]
    return [t.replace("  ", " ") for t in texts], flags


def split_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofread.chunks(cues(spark, sf_dir))


def dialogue_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofread.dialogue_only(cues(spark, sf_dir))


def proofread_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.proofread_job(cues(spark, sf_dir), _corrector)[1].select("file_id", "idx", "line_no", "rule_id", "detail", "auto", "excerpt")


def proofread_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.proofread_job(cues(spark, sf_dir), _corrector)[0].select("file_id", "idx", "text")


def term_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.term_extract(cues(spark, sf_dir))


def terms_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the cues looked up in tables that are made of other names of the cues."""
    c = cues(spark, sf_dir)
    low = language.acronyms(c).select(F.lower("term").alias("source"), F.concat(F.lit("사전 "), "term").alias("korean"), "first_idx").groupBy("source").agg(F.min("korean").alias("korean"), F.min("first_idx").alias("pos"))
    links = dialogue(spark, sf_dir).select(F.explode(F.split(F.regexp_replace("text", r"[^A-Za-z ]", " "), " +")).alias("title")).filter("length(title) > 3").distinct().withColumn("target", F.concat("title", F.when(F.length("title") % 2 == 0, " (영화)").otherwise("")))
    links = links.groupBy(F.lower("title").alias("title")).agg(F.min("target").alias("target"))
    return jobs.terms_job(c, spark.createDataFrame([("J.F.K.", "케네디")], "term string, korean string"), low, links)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which some name the others with a form of address, and every fifth has no label."""
    c, idx = dialogue(spark, sf_dir), F.col("idx")
    flat = F.regexp_replace("text", r"\n", " ")
    return c.withColumn("text", F.when(idx % 5 == 4, F.regexp_replace(flat, r"^\[[a-z]+\] ", "")).when(idx % 3 == 0, F.concat(flat, F.lit(" assistant 님 user씨"))).when(idx % 7 == 1, F.concat(flat, F.lit(" 갔습니다."))).otherwise(flat))


_PEOPLE = r"""with d0 as (select conv_id as file_id, (turn + 1)::int as idx, role, replace(text, chr(10), ' ') as t, length(text) as n from conversations),
dur as (select *, 300 + (n * 37 + idx * 101) % 8200 as dur, (idx * 7919 + file_id * 104729) % 1500 - 300 as lead from d0),
d as (select file_id, idx, (sum(lead + dur) over (partition by file_id order by idx) + 1000 - dur)::bigint as start_ms, role as label, case when idx % 5 = 4 then t when idx % 3 = 0 then t || ' assistant 님 user씨' when idx % 7 = 1 then t || ' 갔습니다.' else t end as body, idx % 5 <> 4 and trim(t) <> '' as tagged from dur)"""


def cast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cast_job(_people(spark, sf_dir))["people"]


def cast_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cast_job(_people(spark, sf_dir))["relations"].withColumn("calls", F.array_join("calls", ", "))


def untagged_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cast_job(_people(spark, sf_dir))["untagged"]


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.summary_by_kind(language_queries.translation_flags(spark, sf_dir), ["file_id", "kind"], certain=F.col("certain"), estimated=~F.col("certain"))


def spot_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions where every third file has speech of the model, from two frames before each loud span."""
    c = cues(spark, sf_dir)
    s = speech(c)
    spans = s.withColumn("method", F.lit("loudness")).unionByName(s.filter("file_id % 3 = 0").withColumn("method", F.lit("vad")).withColumn("start_ms", F.col("start_ms") + 1))
    return jobs.spot_job(c, spans, shots(c))[1]


def genre_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues outside the durations of each genre laid over one profile."""
    c, parts = cues(spark, sf_dir), []
    for name in GENRES:
        parts.append(timing.off_recommendation(c, *recommended_ms(with_genre(FULL, name, GENRES))).withColumn("genre", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (split_markup, dialogue_only, proofread_findings, proofread_rebuilt, term_extract, terms_job, cast_profile, cast_relations, untagged_dialogue, flag_summary, spot_job, genre_durations)}

_MARKS = r"(\[[^\]]*\]|♪|\{\\[^}]*\}|<[^>]+>)"
_CHUNKS = rf"""with {CUES_SQL}, li as (select file_id, idx, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line_no from cues),
da as (select file_id, idx, line_no, regexp_extract(line, '^\s*-\s*') as dash, substr(line, length(regexp_extract(line, '^\s*-\s*')) + 1) as rest from li),
sp as (select *, regexp_split_to_array(rest, '{_MARKS}') as between_, regexp_extract_all(rest, '{_MARKS}') as marks from da),
pa as (select *, list_filter(list_concat([{{'markup': true, 'text': dash}}], flatten(list_transform(range(1, len(between_) + 1), lambda i: [{{'markup': false, 'text': between_[i]}}, {{'markup': true, 'text': coalesce(marks[i], '')}}]))), lambda c: c.text <> '') as cs from sp),
ch as (select file_id, idx, line_no, unnest(range(len(cs)))::int as chunk_no, unnest(cs) as c from pa),
chunks as (select file_id, idx, line_no, chunk_no, c.markup as markup, c.text as text from ch)"""
_SAID = rf"{_CHUNKS}, said as (select file_id, idx, line_no, chunk_no, text from chunks where not markup and regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')"
_T = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _spotting(name: str, of: str, lead: int, out: int) -> str:
    frame = "(1000.0::double / 23.976)"
    return f"""{name}_v as (select c.file_id, c.idx, c.start_ms, c.end_ms, nx, min(s.start_ms) as voice, max(s.end_ms) as q0 from c left join {name} s on s.file_id = c.file_id and s.end_ms > c.start_ms and s.start_ms < c.end_ms where {of} group by 1, 2, 3, 4, 5),
    {name}_w as (select *, voice - {lead} * {frame} as wi, least(least(q0, coalesce(nx, q0)) + {out} * {frame}, coalesce(nx::double, 1e18)) as wo from {name}_v),
    {name}_s as (select file_id, idx, 'start_ms' as field, start_ms as current, start_ms as suggested from {name}_w where voice is null
    union all select file_id, idx, 'start_ms', start_ms, round_even(wi, 0)::bigint from {name}_w where abs(start_ms - wi) > 4 * {frame}
    union all select file_id, idx, 'end_ms', end_ms, round_even(wo, 0)::bigint from {name}_w where voice is not null and abs(end_ms - wo) > 4 * {frame})"""


_LEVEL = """case when regexp_matches(e, '(니다|니까)$') and (unicode(substr(e, length(e) - 2, 1)) - 44032) % 28 = 17 or regexp_matches(e, '(십시오|십시다)$') then '합니다체' when regexp_matches(e, '(요|죠)$') then '해요체' end"""
ORACLE = {
    "split_markup": f"{_CHUNKS} select * from chunks",
    "dialogue_only": f"{_SAID} select * from said",
    "proofread_findings": f"""{_SAID} select file_id, idx, line_no, 'K01' as rule_id, '-> ' || {_T("replace(text, '  ', ' ')")} as detail, true as auto, {_T('text')} as excerpt from said where contains(text, '  ')
        union all select file_id, idx, line_no, 'K02', '''…'' — 말줄임표', false, {_T('text')} from said where contains(text, '...')""",
    "proofread_rebuilt": f"{_CHUNKS}, ln as (select file_id, idx, line_no, string_agg(case when markup then text else replace(text, '  ', ' ') end, '' order by chunk_no) as line from chunks group by 1, 2, 3) select li.file_id, li.idx, string_agg(coalesce(ln.line, ''), chr(10) order by li.line_no) as text from li left join ln on ln.file_id = li.file_id and ln.idx = li.idx and ln.line_no = li.line_no group by 1, 2",
    "cast_profile": rf"""{_PEOPLE}, e as (select *, regexp_replace(trim(regexp_replace(body, '[\[(][^)\]]*[\])]|\{{[^}}]*\}}|♪', '', 'g')), '[\s.,!?…~"''”’)\-]+$', '') as e from d where tagged)
        select file_id, label, count(*) as lines, min(idx) as first_idx, arg_min(start_ms, idx) as first_ms, count(*) filter (lv = '합니다체') as formal, count(*) filter (lv = '해요체') as polite, count(*) filter (lv is null) as undecided from (select *, {_LEVEL} as lv from e) group by 1, 2""",
    "cast_relations": f"""{_PEOPLE}, n as (select distinct file_id, label as other from d where tagged), m as (select d.file_id, label as speaker, other, body from d join n on n.file_id = d.file_id and label <> other and contains(body, other) where tagged)
        select file_id, speaker, other, count(*) as mentions, array_to_string(list_sort(list_distinct(list_filter(flatten(list([case when regexp_matches(body, other || '\\s*님($|[^\\p{{L}}\\p{{N}}_])') then '님' end, case when regexp_matches(body, other || '\\s*씨($|[^\\p{{L}}\\p{{N}}_])') then '씨' end])), lambda x: x is not null))), ', ') as calls from m group by 1, 2, 3""",
    "untagged_dialogue": f"{_PEOPLE} select file_id, count(*) filter (tagged) as tagged, count(*) filter (not tagged and trim(body) <> '') as untagged from d group by 1",
    "flag_summary": f"select file_id, kind, count(*) as n, count(*) filter (certain) as certain, count(*) filter (not certain) as estimated from ({language_queries.ORACLE['translation_flags']}) group by 1, 2",
    "spot_job": f"""with {CUES_SQL}, {SPEECH_SQL}, c as (select *, lead(start_ms) over (partition by file_id order by start_ms, idx) as nx from cues), v3 as (select file_id, start_ms + 1 as start_ms, end_ms from speech where file_id % 3 = 0), loud as (select * from speech where file_id % 3 <> 0),
        {_spotting('v3', 'c.file_id in (select file_id from v3)', 2, 3)}, {_spotting('loud', 'c.file_id not in (select file_id from v3)', 3, 12)}
        select *, 'speech' as by from v3_s union all select *, 'speech' from loud_s union all select *, 'shot' from (select file_id, idx, field, current, suggested from ({TIMING_SQL['shot_change_suggestions']}))""",
    "genre_durations": f"with {CUES_SQL} select file_id, idx, end_ms - start_ms as duration_ms, g as genre from cues, (values ('documentary', 3000, 5000), ('drama', 2000, 3000), ('variety', null, 2000)) v(g, lo, hi) where end_ms - start_ms < lo or end_ms - start_ms > hi",
}
