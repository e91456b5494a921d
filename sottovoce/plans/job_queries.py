"""Registered queries of the jobs, with SQL where all their parts have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.plans import check_queries, file_queries, jobs
from sottovoce.plans.profiles import FULL, merge
from sottovoce.sources import sheets
from sottovoce.sources.fixtures import CUES_SQL, SPEECH_SQL, cues, dialogue, second_track, speech, table
from sottovoce.sources.scratch import scratch
from sottovoce.sources.stage_store import StageStore


def lint_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lint_job(cues(spark, sf_dir), FULL).groupBy("file_id", "check").agg(F.count("*").alias("n"))


def corpus_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    tag = lambda d, track, lang, kind: d.select("*", F.lit(track).alias("track"), F.lit(lang).alias("lang"), F.lit(kind).alias("kind"))
    all_tracks = tag(c, 1, "ko", "sdh").unionByName(tag(c.filter("idx % 2 = 0"), 2, "ko", "plain")).unionByName(tag(second_track(c), 3, "en", "plain"))
    return jobs.corpus_job(all_tracks, "en", "ko")["summary"].drop("listed")


def draft_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return jobs.draft_job(c, {"limits": merge({"l": FULL["limits"]}, {"l": {"max_lines": 2}})["l"]}, None, speech(c))


def evaluate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return jobs.evaluate_job(c, second_track(c))


def translate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.translate_job(cues(spark, sf_dir), str.upper)[0]


def preferred_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speech(cues(spark, sf_dir))
    spans = s.withColumn("method", F.lit("loudness")).unionByName(s.filter("file_id % 3 = 0").withColumn("method", F.lit("vad")).withColumn("start_ms", F.col("start_ms") + 1))
    return jobs.preferred_speech(spans)


def revision_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round closes one double blank; every fifth cue would be doubled, which the guard refuses."""

    def revise(c: DataFrame) -> DataFrame:
        return c.withColumn("text", F.when(F.col("idx") % 5 == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.regexp_replace("text", "^((?s).*?)  ", "$1 ")))

    return jobs.revision_rounds(cues(spark, sf_dir), revise)[0].select("file_id", "idx", "text")


def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return jobs.evaluation(c, second_track(c))["pairs"]


def evaluation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations written as one JSON file a title and read again."""
    c = cues(spark, sf_dir)
    folder = f"{scratch(spark.range(1), 'evaluations').inputFiles()[0].rpartition('/')[0]}/titles"
    sheets.write_titles(jobs.evaluation(c, second_track(c), note="sample")["files"], folder, "json")
    pair = "array<struct<truth_idx: int, ours_idx: int, start_diff: long, end_diff: long, truth_text: string, ours_text: string, similarity: double>>"
    read = sheets.read_titles(spark, folder).select("file_id", F.from_json("value", f"note string, fps double, summary struct<ours: long, truth: long, matched: long, missing: long, extra: long>, pairs {pair}").alias("j"))
    return read.select("file_id", "j.note", "j.fps", "j.summary.*", F.size("j.pairs").alias("pairs"))


def cast_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast documents of all conversations, with a sheet for every second one."""
    c = dialogue(spark, sf_dir)
    job = jobs.cast_job(c)
    sheet = job["people"].filter("file_id % 2 = 0").select("file_id", F.col("label").alias("speaker"), F.lit("형사").alias("job"), F.create_map(F.lit("x"), F.lit("동료")).alias("relations"))
    return sheets.cast_markdown(job["people"], job["relations"], job["untagged"], sheet)


def cast_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of the speakers of each conversation, their columns in two orders, read by header."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    tone = F.when(F.col("role") == "user", " 해요 체").when(F.col("n") > 2, "하십시오체").otherwise("정해 주세요")
    relations = F.concat(F.lit("user: 상사; bad ;:x; assistant :"), F.col("role"), F.lit(";user:부하"))
    one = F.concat_ws("\t", "role", tone, F.col("n").cast("string"), relations)
    two = F.concat_ws("\t", F.lit("old"), relations, F.concat(F.lit(" "), F.col("n").cast("string")), tone, F.lit("-"), F.col("role"), F.lit("x"))
    rows = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", F.when(F.col("conv_id") % 2 == 0, one).otherwise(two).alias("line")))).alias("rows"))
    head = F.when(F.col("conv_id") % 2 == 0, "이름\t말투 지정\t대사 수\t관계").otherwise("이름\t관계\t대사 수\t말투 지정\t직업\t이름 \t모름")
    files = rows.select(F.col("conv_id").cast("string").alias("path"), F.concat(head, F.lit("\r\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("value"))
    read = sheets.parse_cast_sheets(files)
    return read.select("path", "speaker", "tone", "job", "lines", F.element_at("relations", "user").alias("to_user"), F.size("relations").alias("n_relations"))


def stage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three steps of all files; the second was saved twice, and the third lacks some cues."""
    c = cues(spark, sf_dir)
    store = StageStore(spark, f"{scratch(spark.range(1), 'stages').inputFiles()[0].rpartition('/')[0]}/store")
    c = store.save(c, "01-draft", model="m", seconds=1.25)
    store.save(c.limit(0), "02-timing")
    store.save(c.withColumn("end_ms", F.col("end_ms") + F.when(F.col("idx") % 9 == 4, 1).otherwise(0)), "02-timing", note="again")
    store.save(c.filter("idx % 5 <> 0 and file_id % 3 <> 0"), "03-cut")
    return store.steps().select("file_id", "step", "seq", "cues", "model", "seconds", "note", "moved_count", F.array_join(F.transform("moved", lambda x: x.cast("string")), ",").alias("moved"))


QUERIES = {f.__name__: f for f in (lint_job, corpus_job, draft_job, evaluate_job, translate_job, preferred_speech, revision_rounds, evaluation_pairs, evaluation_files, cast_documents, cast_sheets, stage_steps)}
_ONCE = "regexp_replace({}, '^((?s).*?)  ', '\\1 ')"
_THRICE = _ONCE.format(_ONCE.format(_ONCE.format("text")))
ORACLE = {
    "cast_sheets": """with t as (select conv_id, role, count(*) as n from conversations group by all)
        select conv_id::varchar as path, role as speaker, case when role = 'user' then '해요체' when n > 2 then '합니다체' else '' end as tone, '' as job, n::int as lines, '부하' as to_user, 2 as n_relations from t""",
    "stage_steps": f"""with {CUES_SQL}, o as (select *, row_number() over (partition by file_id order by idx) as nr from cues), k as (select file_id, idx, start_ms, end_ms, row_number() over (partition by file_id order by idx) as nr from cues where idx % 5 <> 0 and file_id % 3 <> 0),
        d as (select k.file_id, k.idx, k.nr from k join o on k.file_id = o.file_id and k.nr = o.nr where k.idx <> o.idx)
        select file_id, '01-draft' as step, 1 as seq, count(*) as cues, 'm' as model, 1.25::double as seconds, '' as note, 0 as moved_count, '' as moved from cues group by 1
        union all select file_id, '02-timing', 2, count(*), '', null, 'again', count(*) filter (idx % 9 = 4), coalesce(array_to_string((list(idx order by idx) filter (idx % 9 = 4))[1:20], ','), '') from cues group by 1
        union all select c.file_id, '03-cut', 3, count(*) filter (idx % 5 <> 0), '', null, '', count(*) filter (idx % 5 = 0), coalesce((select array_to_string((list(idx order by nr))[1:20], ',') from d where d.file_id = c.file_id), '') from cues c where c.file_id % 3 <> 0 group by 1""",
    "revision_rounds": f"with {CUES_SQL} select file_id, idx, case when idx % 5 = 0 and trim(text) <> '' then text else {_THRICE} end as text from cues",
    "preferred_speech": f"with {CUES_SQL}, {SPEECH_SQL} select file_id, start_ms, end_ms, 'loudness' as method from speech where file_id % 3 <> 0 union all select file_id, start_ms + 1, end_ms, 'vad' from speech where file_id % 3 = 0",
}


def _counts() -> str:
    """Findings of all checks by file and check, in one statement: those that need no more than the common tables share them."""
    by_file = {name: file_queries.ORACLE[f"check_{name}"] for name in ("gap_too_short", "speaker_id_inconsistent")}
    by_file["position_collides_with_forced_narrative"] = file_queries.ORACLE["check_position_collides"]
    mixed = "case when idx % 5 = 0 then replace(text, '...', '…') else text end"
    by_file["ellipsis_style_inconsistent"] = file_queries.ORACLE["check_ellipsis_style_inconsistent"].replace(mixed, "text")
    by_file["first_event_at_zero"] = file_queries.ORACLE["check_first_event_at_zero"].replace("<= 1000", "<= 0")
    cue = {name: check_queries.ORACLE[f"check_{name}"] for name in check_queries.CHECKS}
    cue = {name: sql.removeprefix(check_queries.BASE) if sql.startswith(f"{check_queries.BASE} select") else sql for name, sql in cue.items()}
    return check_queries.BASE + " union all ".join(f"""select file_id, '{name}' as "check", count(*) as n from ({sql}) group by 1""" for name, sql in (cue | by_file).items())


ORACLE["lint_job"] = _counts()
ORACLE["whole_lint_folder"] = f"with c as ({_counts()}), f as (select file_id, sum(n)::bigint as n from c group by 1), k as (with {CUES_SQL} select file_id, count(*) as cues from cues group by 1) select k.file_id, cues, coalesce(n, 0) as findings, n is not null as failed from k left join f on k.file_id = f.file_id"
