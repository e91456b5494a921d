"""Registered queries of the look-ups, with SQL where it is short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.functions.text import TAGS
from sottovoce.operators import checks, language, reference_data, timing
from sottovoce.plans import file_queries, language_queries, timing_queries
from sottovoce.plans.file_queries import SAMPLE_RULES, violations
from sottovoce.plans.profiles import FULL, rules_table
from sottovoce.sources.fixtures import CUES_SQL, cues, speech, table
from sottovoce.sources.scratch import scratch

LEXICON = [
    ("문", "[문이 닫힌다]"), ("문", "[닫히는 문]"), ("문", "[문이 쾅 닫힌다]"), ("문", "[문을 두드린다]"), ("차", "[자동차 경적]"), ("차", "[자동차가 급히 멈춘다]"), ("쾅", "[쾅 소리]"), ("음악", "[잔잔한 음악]"), ("음악", "[음악이 멈춘다]"),
    ("음악", "[잔잔한 피아노 음악]"), ("발", "[발을 구른다]"), ("물", "[물이 흐른다]"), ("물", "[흐르는 물]"), ("새", "[새가 지저귄다]"), ("닫힘", "[닫히는 창문]"), ("닫힘", "[닫히는 서랍]"),
]


def effect_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for the effect markers of all cues, by cue."""
    c = cues(spark, sf_dir).select("file_id", "idx", F.explode(F.regexp_extract_all("text", F.lit(r"(\[[^\]]*\])"), F.lit(1))).alias("marker"))
    return c.join(reference_data.effect_suggestions(c, spark.createDataFrame(LEXICON, "category string, term string")), "marker")


def effect_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discouraged effect endings, and effect markers, with what the lexicon suggests."""
    c = cues(spark, sf_dir)
    found = checks.findings(c, FULL, ["discouraged_sound_ending"]).select("file_id", "idx", "detail")
    return reference_data.with_effect_hints(found, spark.createDataFrame(LEXICON, "category string, term string"))


def infobox_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages that are made of the cues."""
    name = F.regexp_replace("text", r"[|{}\[\]<>=']|\n", " ")
    kind = F.when(F.col("idx") % 2 == 0, "{{Infobox character").otherwise("Intro {{x}} {{Character infobox")
    page = F.concat(kind, F.lit(" | name = [[x|"), name, F.lit("]] | species = {{a|b}} human | age = "), F.col("idx").cast("string"), F.lit(" }} Intro."))
    fields = cues(spark, sf_dir).select("file_id", "idx", reference_data.infobox(page).alias("f"))
    return fields.select("file_id", "idx", reference_data.pick(F.col("f"), ["full name", "name"]).alias("name"), reference_data.pick(F.col("f"), ["age"]).alias("age"), reference_data.pick(F.col("f"), ["species"]).alias("species"))


def cast_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cues(spark, sf_dir).select(F.concat(F.lit("P"), F.col("file_id").cast("string")).alias("name"), F.when(F.col("file_id") % 5 == 0, "known").alias("description")).distinct()
    pages = people.select(F.col("name").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).select("query", "rank", F.when(F.col("rank") == 2, F.lower("query")).otherwise(F.concat("query", "rank")).alias("title"), F.concat(F.lit("d"), "rank").alias("description"))
    return reference_data.cast_research(people, pages)


SKIPPED = ("formality_inconsistent (화자별 말투를 정하지 않았습니다)",)


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all files, with the warning of another platform and the spotting suggestions."""
    rules = rules_table(spark, {"s": {"rules": SAMPLE_RULES}})
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("f"), "doc_id", F.lit(".srt")).alias("name"))
    missing = checks.unimplemented(rules, [*checks.CHECKS, "gap_too_short"])
    # The parts of a report look at other columns of the same cues, which are made once.
    c = scratch(cues(spark, sf_dir), "report", "zstd")
    warnings, suggestions = language.profile_mismatch(c, "netflix", "sdh"), timing.spotting_suggestions(c, speech(c))
    return reference_data.report_text(files, violations(c), "sample sdh", "sample source", warnings, suggestions, missing, SKIPPED)


QUERIES = {f.__name__: f for f in (effect_suggestions, effect_hints, infobox_fields, cast_research, report_text)}


def _tokens(x: str) -> str:
    words = f"list_transform(regexp_extract_all({x}, '[가-힣]{{2,}}'), lambda w: case when length(w) > 2 then regexp_replace(w, '{reference_data.PARTICLES}', '') else w end)"
    return f"list_filter({words}, lambda w: length(w) >= 2 and not list_contains({reference_data.EMPTY_WORDS}, w))"


ORACLE = {
    "infobox_fields": rf"with {CUES_SQL}, v as (select file_id, idx, trim(regexp_replace(regexp_replace(regexp_replace(text, '[|{{}}\[\]<>='']|\n', ' ', 'g'), '\s+', ' ', 'g'), '\s*[*•]\s*', ' / ', 'g'), ' /*•-') as name from cues) select file_id, idx, case when name <> '' then name end as name, idx::varchar as age, 'b human' as species from v",
    "effect_hints": f"""with {CUES_SQL}, m as (select file_id, idx, '[' || unnest(regexp_extract_all(regexp_replace(text, '{TAGS}', '', 'g'), '\\[([^\\]]*)\\]', 1)) || ']' as marker from cues),
        bad as (select * from m where regexp_matches(regexp_replace(regexp_replace(marker[2:-2], '^\\s+|\\s+$', '', 'g'), '\\.+$', ''), '(소리|소음)$')), lx as (select unnest({[t for _, t in LEXICON]}) as term),
        mt as (select distinct marker, {_tokens('marker')} as ws from bad), lt as (select term, {_tokens('term')} as ts from lx),
        hit as (select marker, term, list_filter(range(1, len(ws) + 1), lambda i: len(list_filter(ts, lambda t: starts_with(t, ws[i]) or starts_with(ws[i], t))) > 0) as spots from mt, lt where term <> marker),
        rk as (select *, row_number() over (partition by marker order by len(spots) + case when list_contains(spots, 1) then 1 else 0 end desc, length(term), term) as r from hit where len(spots) > 0),
        hn as (select marker, string_agg(term, ' / ' order by r) as terms from rk where r <= 3 group by 1)
        select file_id, idx, bad.marker || coalesce(' — {reference_data.HINT}' || terms, '') as detail from bad left join hn on bad.marker = hn.marker""",
    "cast_research": f"with {CUES_SQL} select distinct 'P' || file_id as name, case when file_id % 5 = 0 then 'known' else 'd2' end as description, '3 pages' as note from cues",
}
ORACLE["report_text"] = f"""with v as ({file_queries.ORACLE["violation_report"]}), wn as ({language_queries.ORACLE["profile_mismatch"]}), sg as ({timing_queries.ORACLE["spotting_suggestions"]}),
    ln as (select *, '#' || idx || coalesce(' ' || line_no || '행', '') as place from v),
    fd as (select file_id, count(*) as n, string_agg('  [' || case when auto then '자동' else '확인' end || '] ' || repeat(' ', greatest(10 - length(place), 0)::bigint) || place || '  ' || rule_id || ' ' || clause || case when excerpt <> '' then chr(10) || repeat(' ', 14) || '| ' || excerpt else '' end || chr(10) || repeat(' ', 14) || message || case when detail <> '' then chr(10) || repeat(' ', 14) || '-> ' || detail else '' end, chr(10) order by idx, rule_id, coalesce(line_no, 0)) as t from ln group by 1),
    ct as (select file_id, '  규칙별 집계' || chr(10) || string_agg('    ' || repeat(' ', greatest(4 - length(n::varchar), 0)::bigint) || n || '건  ' || rule_id || '  ' || message, chr(10) order by n desc, rule_id, message) || chr(10) || chr(10) as t from (select file_id, rule_id, message, count(*) as n from v group by all) group by 1),
    ss as (select file_id, count(*) as n, list('    #' || idx || ' ' || field || ' ' || "current" || ' -> ' || suggested || 'ms' order by idx, field) as ls from sg group by 1)
    select doc_id as file_id, 'f' || doc_id || '.srt — sample sdh' || chr(10) || '  기준: sample source' || chr(10) || coalesce('  ⚠ ' || warning || chr(10), '') || coalesce(fd.t, '  위반 없음') || chr(10) || chr(10) || coalesce(ct.t, '') || '  위반 ' || coalesce(fd.n, 0) || '건'
        || coalesce(chr(10) || '  스포팅 제안 ' || ss.n || '건 (자동 적용 안 함)' || chr(10) || array_to_string(ls[1:8], chr(10)) || case when ss.n > 8 then chr(10) || '    … 외 ' || (ss.n - 8) || '건' else '' end, '') || chr(10) || '  미구현 검사 1건: R04 (glyph_not_allowed)' || chr(10) || '  돌지 못한 검사: {SKIPPED[0]}' as report
    from documents left join fd on fd.file_id = doc_id left join ct on ct.file_id = doc_id left join wn on wn.file_id = doc_id left join ss on ss.file_id = doc_id"""
