"""Whole lines reach the operators."""

from pyspark.sql import functions as F
from sottovoce.operators import fixes, timing
from sottovoce.plans import jobs
from sottovoce.plans.profiles import FULL
from sottovoce.plans.registry import QUERIES
from sottovoce.sources import fixtures

LINE = " ".join(f"word{i}" for i in range(40)) + " OMEGA"


def tables(spark, folder):
    spark.createDataFrame([(1, "\n".join([LINE] * 17))], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", LINE)], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_cues_and_turns_are_whole(spark, tmp_path):
    at = tables(spark, tmp_path)
    cues = fixtures.cues(spark, at).orderBy("idx").collect()
    assert [c.idx for c in cues] == list(range(1, len(cues) + 1)) and len(cues) == 17 * -(-len(LINE) // 60)
    # Whatever its defect, a cue holds all of its part of the line.
    parts = [LINE[i : i + 60].strip() for i in range(0, len(LINE), 60)] * 17
    flat = lambda x: x.replace("\n", "").replace(" ", "")
    assert all(flat(p) in flat(c.text) for p, c in zip(parts, cues, strict=True))
    assert fixtures.dialogue(spark, at).first().text == f"[user] {LINE}"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outlier_spans_gather_no_rows_by_key(spark):
    values = [0.1, 0.2, 0.2, 0.3, 9.0, 9.5, 0.1, None, 0.2, 7.0]
    rows = [(m, i, p) for m in (1, 2) for i, p in enumerate(values)] + [(3, 0, 1.0), (3, 1, 9.0)]
    df = spark.createDataFrame(rows, "media_id int, i long, p double")
    got = timing.outlier_spans(df)
    assert sorted((r.media_id, r.start_ms, r.end_ms) for r in got.collect()) == [(m, a, b) for m in (1, 2) for a, b in ((128, 192), (288, 320))]
    assert "collect_list" not in plan_of(got)


def test_rows_are_numbered_by_hours(spark):
    rows = [(e % 3, f"2024-01-0{1 + e % 4} 0{e % 7}:00:{e % 60:02d}", e) for e in range(200)]
    df = spark.createDataFrame(rows, "k int, ts string, e int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.k, r.i) for r in fixtures.numbered(df, "k", "ts", "e").collect())
    assert got == sorted((k, i) for k in range(3) for i in range(sum(r[0] == k for r in rows)))
    assert plan_of(fixtures.numbered(df, "k", "ts", "e")).count("hour") > 1


def test_jobs_use_all_checks_and_fixers(spark, tmp_path):
    at = tables(spark, tmp_path)
    c = fixtures.cues(spark, at)
    assert QUERIES["whole_lint_folder"](spark, at).first().findings == jobs.lint_job(c, FULL).count()
    got = {r.check for r in QUERIES["whole_correct_and_check"](spark, at).select("check").distinct().collect()}
    assert got == {r.check for r in jobs.correct_and_check(c, FULL)[1].select("check").distinct().collect()}
    assert {"gap_too_short", "line_length"} & got


def test_translation_and_transcript_take_every_cue(spark, tmp_path):
    at = tables(spark, tmp_path)
    n = fixtures.cues(spark, at).count()
    assert {r.idx for r in QUERIES["back_translation_overlap"](spark, at).collect()} == set(range(1, n + 1))
    said = {r.text for r in fixtures.cues(spark, at).collect()}
    aligned = QUERIES["align_transcript"](spark, at).collect()
    assert len([r for r in aligned if r.start_ms < r.end_ms]) == n and {r.text for r in aligned if r.source == "transcript"} <= said


def test_whole_correction_has_an_effect_on_the_checks(spark, tmp_path):
    at = tables(spark, tmp_path)
    count = lambda df: {r["check"]: r["count"] for r in df.groupBy("check").count().collect()}
    before, after = count(jobs.lint_job(fixtures.cues(spark, at), FULL)), count(QUERIES["whole_correct_and_check"](spark, at))
    settled = {"three_dot_ellipsis", "double_space", "italics_present", "acronym_with_periods", "dual_speaker_marker_format", "currency_bul", "colon_speaker_prefix", "space_between_markers", "music_note_spacing", "ellipsis_style_mismatch", "position_collides_with_forced_narrative"}
    assert settled & set(before) >= settled - {"position_collides_with_forced_narrative"} and not settled & set(after)
    # What no fixer settles stays.
    assert {"tilde_used", "double_punctuation", "gap_too_short"} <= set(after)
    assert fixes.fix_names(FULL) == (list(fixes.FIXES), []) and fixes.moves_positions(FULL)


def test_dialogue_goes_away_from_shown_text_before_texts_are_fixed(spark):
    rows = [(1, 1, 0, 2000, "3천 불을..."), (1, 2, 1000, 3000, '"서울"'), (2, 1, 0, 2000, "가자")]
    c = spark.createDataFrame(rows, "file_id long, idx int, start_ms long, end_ms long, text string")
    fixed, found = jobs.correct_and_check(c, FULL)
    assert {(r.file_id, r.idx): r.text for r in fixed.collect()} == {(1, 1): "{\\an8}3천 달러를…", (1, 2): '"서울"', (2, 1): "가자"}
    assert "position_collides_with_forced_narrative" not in {r.check for r in found.collect()}
    kept, _ = jobs.correct_and_check(c, {**FULL, "rules": []})
    assert {r.text for r in kept.collect()} == {r[4] for r in rows}


def test_findings_are_counted_without_rows(spark):
    rows = [(1, 1, 0, 2000, "3천 불을... [쾅 소리] 가자~"), (1, 2, 1000, 3000, '"서울"'), (1, 3, 5000, 5100, None), (2, 1, 90000, 93000, "가자")]
    c = spark.createDataFrame(rows, "file_id long, idx int, start_ms long, end_ms long, text string")
    counts = jobs.lint_counts(c, FULL)
    found = {r.file_id: r["count"] for r in jobs.lint_job(c, FULL).groupBy("file_id").count().collect()}
    assert {(r.file_id, r.cues, r.findings) for r in counts.collect()} == {(1, 3, found[1]), (2, 1, found.get(2, 0))}
