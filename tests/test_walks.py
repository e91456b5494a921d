"""Two tracks walked as one: nothing meets in joins, and what is kept does not grow with the file."""

import pytest
from pyspark.sql import functions as F
from sottovoce.operators import timing, tracks, walks
from sottovoce.plans import jobs
from sottovoce.sources import sheets

CUES = "file_id long, idx int, start_ms long, end_ms long, text string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_joins_no_texts(spark):
    ours = spark.createDataFrame([(1, 1, 0, 900, "go home")], CUES)
    for df in (tracks.match_to_reference_track(ours, ours), jobs.evaluate_job(ours, ours), *jobs.evaluation(ours, ours).values()):
        assert "Join" not in plan_of(df) and "Generate" not in plan_of(df)


def test_matching_keeps_only_near_cues():
    walk, most = walks.Matching(2000, 0.3), 0
    for i in range(5000):
        for side in (0, 1):
            walk.take((1, side, i, i * 1000, i * 1000 + 900, f"w{i} x"))
            most = max(most, len(walk.near[0]) + len(walk.near[1]) + len(walk.waiting))
    walk.end()
    assert most < 20 and len(walk.done) == 5000 and all(d[1] == d[5] == i and d[9] == 1.3 for i, d in enumerate(walk.done))


def test_matching_leaves_no_cue_out(spark):
    ours = [(1, 1, None, 900, "go"), (1, 2, 0, None, "go"), (None, 3, 0, 900, "go"), (1, 4, 5000, 4000, "back"), (1, 5, 0, 90000, "long"), (1, 6, 6000, 6500, None), (2, 1, 0, 900, "alone")]
    truth = [(1, 1, 0, 500, "go"), (None, 2, 0, 900, "go"), (1, 3, 6100, 6400, None), (1, 4, None, None, "go"), (1, 5, 95000, 96000, "far")]
    got = tracks.match_to_reference_track(spark.createDataFrame(ours, CUES), spark.createDataFrame(truth, CUES)).collect()
    assert sorted((r.our_idx for r in got if r.our_idx), key=int) == [1, 1, 2, 3, 4, 5, 6] and sorted(r.truth_idx for r in got if r.truth_idx) == [1, 2, 3, 4, 5]
    assert {(r.our_idx, r.truth_idx, r.score) for r in got if r.our_idx and r.truth_idx} == {(5, 1, 0.3), (6, 3, 0.3)}


def test_alignment_joins_and_writes_nothing(spark):
    segments = spark.createDataFrame([(1, 1, 0, 900, "go home now"), (1, 2, 1000, 1900, None), (3, 1, 5, 9, "alone")], CUES)
    script = spark.createDataFrame([(1, 1, "go home now"), (1, 2, None), (1, 3, "the end"), (2, 1, "unsaid")], "file_id long, pos int, text string")
    df = tracks.align_transcript(segments, script)
    got = [tuple(r)[:6] for r in df.orderBy("file_id", "pos").collect()]
    assert "Join" not in plan_of(df) and "CoGroup" not in plan_of(df) and "FileScan" not in plan_of(df)
    assert got == [
        (1, 1, 0, 900, "go home now", "script"), (1, 2, 1000, 1900, "", "transcript"), (1, 3, 1900, 1900, None, "script"), (1, 4, 1900, 1900, "the end", "script"),
        (2, 1, 0, 0, "unsaid", "script"), (3, 1, 5, 9, "alone", "transcript"),
    ]


def test_titles_cost_no_folder_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "FOLDER_FILES", 10)
    monkeypatch.setattr(sheets, "READ_BYTES", 50)
    texts = spark.range(95).selectExpr("id as file_id", "concat('{\"a\": \"', id, '\\r\\n가\"}\\n') as json").repartition(2)
    sheets.write_titles(texts, f"file://{tmp_path}/t", "json")
    folders = [p for p in (tmp_path / "t").iterdir()]
    assert len(folders) <= 11 and sorted(int(f.stem) for p in folders for f in p.iterdir()) == list(range(95)) and [p.name for p in tmp_path.iterdir()] == ["t"]
    read = sheets.read_titles(spark, f"file://{tmp_path}/t")
    assert {tuple(r) for r in read.collect()} == {tuple(r) for r in texts.collect()}
    with pytest.raises(FileExistsError):
        sheets.write_titles(texts, str(tmp_path / "t"), "json")
    with pytest.raises(Exception):
        sheets.write_titles(texts.withColumn("json", F.expr("if(file_id = 50, raise_error('lost'), json)")), str(tmp_path / "u"), "json")
    assert not (tmp_path / "u").exists()  # all files appear, or none


def test_resplitting_joins_no_texts(spark):
    cues = spark.createDataFrame([(1, 1, 0, 4000, "one two. three four"), (1, 2, 5000, None, "five six. seven"), (1, 3, 6000, 7000, None)], CUES)
    speech = spark.createDataFrame([(1, 0, 2000), (1, 2300, 4000), (1, None, 5), (1, 9000, None)], "file_id long, start_ms long, end_ms long")
    df = timing.resplit_cues(cues, {"limits": {"chars_per_line": 10, "max_lines": 1}}, speech)
    assert "Join" not in plan_of(df) and "FileScan" not in plan_of(df)
    assert [tuple(r)[1:] for r in df.orderBy("idx").collect()] == [(1, 1, 0, 2150, "one two."), (2, 1, 2150, 4000, "three four"), (3, 2, 5000, None, "five six."), (4, 2, None, None, "seven"), (5, 3, 6000, 7000, None)]


def test_drafting_keeps_texts_in_their_rows(spark):
    segments = spark.createDataFrame([(1, 1, 0, 3000, "one two. three four"), (1, 2, 3100, 4000, "five"), (2, 1, 500, 900, "alone")], CUES)
    speech = spark.createDataFrame([(1, 100, 1400), (1, 1600, 3900)], "file_id long, start_ms long, end_ms long")
    profile = {"limits": {"chars_per_line": 10, "max_lines": 1, "duration_ms": {"min": 500, "max": 7000}}}
    df = jobs.draft_job(segments, profile, None, speech)
    assert "Join" not in plan_of(df) and "FileScan" not in plan_of(df)
    cues = timing.resplit_cues(timing.merge_fragments(segments), profile, speech).drop("origin_idx")
    moved = timing.apply_spotting(cues, timing.spotting_suggestions(cues, speech, detector="vad")).join(cues.select("file_id", "idx", "text"), ["file_id", "idx"])
    want = timing.converge(moved, timing.limits_of(profile)).filter("kind = 'cue'").join(cues.select("file_id", "idx", "text"), ["file_id", "idx"])
    rows = lambda d: sorted(map(tuple, d.select("file_id", "idx", "start_ms", "end_ms", "text").collect()))
    assert rows(df) == rows(want) and len(rows(df)) > 3
