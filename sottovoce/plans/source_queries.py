"""Registered queries of readers and writers, over files that Spark derives from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.functions.text import TAGS
from sottovoce.operators import checks
from sottovoce.plans.file_queries import SAMPLE_RULES
from sottovoce.plans.profiles import FULL, rules_table
from sottovoce.sources import subtitles
from sottovoce.sources.fixtures import CUES_SQL, cues


def srt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.srt_text(cues(spark, sf_dir))


def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as text and parsed again."""
    files = subtitles.srt_text(cues(spark, sf_dir)).select(F.col("file_id").cast("string").alias("path"), F.col("srt").alias("value"))
    return subtitles.parse_blocks(files)


def review_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rules = cues(spark, sf_dir), rules_table(spark, {"s": {"rules": SAMPLE_RULES}})
    found = checks.report(c, checks.findings(c, FULL, ["double_space", "three_dot_ellipsis", "too_many_lines"], kept=("text",)), rules, {})
    return subtitles.review_cues(c, found, shown=1).select("file_id", "idx", "text")


def parse_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    scripts = c.groupBy(F.col("file_id").cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("value"))
    return subtitles.parse_script(scripts)


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    notes = c.filter("idx % 4 = 1").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((F.col("idx") - F.when(F.col("file_id") % 2 == 0, 1).otherwise(0)).alias("idx"), F.concat(F.lit("n<br />"), "idx").alias("txt")))).alias("bookmarks"))
    return subtitles.parse_bookmarks(notes.select("file_id", F.to_json(F.struct("bookmarks")).alias("value")), c)


def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("file_id").cast("string"), F.lit("."), F.col("idx").cast("string"))
    sep = F.element_at(F.array(*map(F.lit, ["\t", " => ", "=", " "])), F.col("idx") % 4 + 1)
    return subtitles.parse_glossary(cues(spark, sf_dir).select(F.concat(F.when(F.col("idx") % 9 == 0, "# ").otherwise(""), F.lit("t"), t, sep, F.lit("k"), t).alias("value")))


def _listing(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    ids = cues(spark, sf_dir).select("file_id").distinct()
    return ids.select(F.format_string(form, F.col("file_id") % 7, F.col("file_id")).alias("path"))


def glossary_of_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.pair_glossary_with_subtitle(_listing(spark, sf_dir, "/w/%d/t%05d_ko_TL.fixed.srt"), _listing(spark, sf_dir, "/w/%d/t%05d KNP.xlsx").filter("path like '%3 KNP%'"))


def video_of_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = _listing(spark, sf_dir, "/w/%d/t%05d.mkv").union(_listing(spark, sf_dir, "/w/%d/t%05d.mp4").filter("path like '%5.mp4'"))
    return subtitles.pair_video_with_subtitle(_listing(spark, sf_dir, "/w/%d/t%05d_TL.srt"), videos)


QUERIES = {f.__name__: f for f in (srt_text, srt_round_trip, review_srt, parse_script, bookmarks, glossary_lines, glossary_of_subtitle, video_of_subtitle)}


def _clock(x: str) -> str:
    t = f"greatest({x}, 0)"
    return f"printf('%02d:%02d:%02d,%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


ORACLE = {
    "srt_text": f"with {CUES_SQL}, r as (select *, row_number() over (partition by file_id order by idx) as rn from cues) select file_id, string_agg(rn || chr(10) || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(10) || text || chr(10), chr(10) order by rn) as srt from r group by 1",
    "srt_round_trip": rf"with {CUES_SQL} select file_id::varchar as path, (row_number() over (partition by file_id order by idx))::int as idx, greatest(start_ms, 0) as start_ms, greatest(end_ms, 0) as end_ms, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from cues",
    "glossary_lines": f"with {CUES_SQL} select 't' || file_id || '.' || idx as term, 'k' || file_id || '.' || idx as korean from cues where idx % 9 <> 0 and idx % 4 <> 3",
    "bookmarks": f"with {CUES_SQL} select file_id, idx, 'n' || chr(10) || idx as note, text as cue from cues where idx % 4 = 1",
    "video_of_subtitle": f"with {CUES_SQL} select distinct printf('/w/%d/t%05d_TL.srt', file_id % 7, file_id) as path, printf('/w/%d/t%05d', file_id % 7, file_id) || case when file_id % 10 = 5 then '.mp4' else '.mkv' end as video from cues",
    "glossary_of_subtitle": f"with {CUES_SQL}, f as (select distinct file_id from cues), b as (select file_id % 7 as dir, min(printf('/w/%d/t%05d KNP.xlsx', file_id % 7, file_id)) as first from f where file_id % 10 = 3 group by 1) select printf('/w/%d/t%05d_ko_TL.fixed.srt', file_id % 7, file_id) as path, case when file_id % 10 = 3 then printf('/w/%d/t%05d KNP.xlsx', file_id % 7, file_id) else first end as book from f join b on f.file_id % 7 = b.dir",
}
ORACLE["review_srt"] = f"""with {CUES_SQL}, k as (select *, string_split(text, chr(10)) as ls from cues),
    f as (select file_id, idx, null::int as line_no, 'R01' as rule_id, len(ls) || '줄 — 최대 1줄' as detail, '' as mark from k where len(ls) > 1 union all select file_id, idx, null::int, 'R03', '''...'' 발견', '[자동]' from k where contains(text, '...')
    union all select file_id, idx, line_no, 'R02', '이중 공백', '[자동]' from (select *, unnest(ls) as l, unnest(range(1, len(ls) + 1))::int as line_no from k) where contains(regexp_replace(l, '{TAGS}', '', 'g'), '  ')),
    b as (select file_id, idx, list(mark || rule_id || ' ' || coalesce(line_no || '행 ', '') || substr(detail, 1, 40) order by rule_id, coalesce(line_no, 0)) as ls from f group by 1, 2)
    select file_id, idx, case when b.ls is null then '·' else b.ls[1] || case when len(b.ls) > 1 then chr(10) || '… 외 ' || (len(b.ls) - 1) || '건' else '' end end as text from cues left join b using (file_id, idx)"""
