"""Proofreading, names, the jobs on them, and what one cue passes to the next."""

import random

import pytest
from pyspark.sql import functions as F

from sottovoce.operators import moves, names, proofread
from sottovoce.plans import jobs, profiles
from sottovoce.sources import subtitles

CUE = "file_id long, idx int, start_ms long, end_ms long, text string"


def table(spark, *texts):
    return spark.createDataFrame([(1, i, i * 2000, i * 2000 + 1500, t) for i, t in enumerate(texts, 1)], CUE)


def test_markup_and_dialogue_alternate_and_come_back(spark):
    text = "- [철수] 안녕 <i>여러분</i>\n♪ 노래 ♪\n{\\an8}위"
    c = table(spark, text, "", "말")
    got = [(r.line_no, r.chunk_no, r.markup, r.text) for r in proofread.chunks(c).filter("idx = 1").orderBy("line_no", "chunk_no").collect()]
    assert got == [
        (1, 0, True, "- "), (1, 1, True, "[철수]"), (1, 2, False, " 안녕 "), (1, 3, True, "<i>"), (1, 4, False, "여러분"), (1, 5, True, "</i>"),
        (2, 0, True, "♪"), (2, 1, False, " 노래 "), (2, 2, True, "♪"), (3, 0, True, "{\\an8}"), (3, 1, False, "위"),
    ]
    none = proofread.rebuild(c, proofread.dialogue_only(c).select("file_id", "idx", "line_no", "chunk_no", F.col("text").alias("after")))
    assert {r.idx: r.text for r in none.collect()} == {1: text, 2: "", 3: "말"}


def test_a_corrector_sees_dialogue_alone_and_its_rows_are_counted(spark):
    c = table(spark, "[되요] 되요", "좋아요\n안되요 ♪")
    fixed, found = jobs.proofread_job(c, lambda texts: ([t.replace("되요", "돼요") for t in texts], [{"line_index": 2, "reason": "r", "suggested_fix": "x", "original_text": "좋아요 "}, {"line_index": 99, "reason": "beyond"}]))
    assert {r.idx: r.text for r in fixed.collect()} == {1: "[되요] 돼요", 2: "좋아요\n안돼요 ♪"}
    assert sorted((r.idx, r.line_no, r.rule_id, r.detail, r.excerpt) for r in found.collect()) == [(1, 1, "K01", "-> 돼요", "되요"), (2, 1, "K02", "'x' — r", "좋아요"), (2, 2, "K01", "-> 안돼요", "안되요")]
    with pytest.raises(Exception, match="returned 1 texts for 3"):
        proofread.corrected(c, lambda texts: (texts[:1], [])).collect()


def test_terms_are_whole_names(spark):
    c = table(spark, "We went to Royal Belum State Park. Nice day.", "Nice to meet you, it is nice. It's Belum!", "The FBI called Bank of Korea and Anna; OK?", "Mr Anna-Maria")
    got = {r.term: (r.kind, r.n, r.context[:6]) for r in names.term_extract(c).collect()}
    assert got["Royal Belum State Park"] == ("place", 1, "We wen") and got["FBI"] == ("acronym", 1, "The FB") and got["Bank of Korea"][0] == "place"
    assert not {"Belum", "Nice", "The", "It's", "OK", "We"} & set(got)


def test_speakers_have_levels_and_relations(spark):
    c = table(spark, "[민수] 갔습니다", "[민수] 영희 씨, 가요", "[영희] 민수가 왔어", "아무도 없다", "[소리]", "[민수] 영희야\n[영희] 응")
    people = {r.label: (r.lines, r.first_idx, r.formal, r.polite, r.undecided) for r in names.cast_profile(c).collect()}
    assert people == {"민수": (3, 1, 1, 1, 1), "영희": (2, 3, 0, 0, 2)}
    calls = {(r.speaker, r.other): (r.mentions, r.calls) for r in names.cross_reference(c).collect()}
    assert set(calls) == {("민수", "영희"), ("영희", "민수")} and calls[("민수", "영희")] == (2, ["씨"])
    left = names.untagged_dialogue(c).first()
    assert (left.tagged, left.untagged) == (5, 1)


def test_a_genre_lies_over_a_profile_and_keeps_its_source():
    base = {"source": {"official": True}, "rules": [{"id": "A", "check": "x"}], "address": {"forbid_ssi": False, "other": 1}}
    genres = {"g": {"schema_version": 1, "label": "G", "genre": "g", "source": {"client": "c"}, "address": {"forbid_ssi": True}, "spotting": {"recommended_ms": [None, 2000]}, "rules": [{"id": "G01", "check": "y"}]}}
    out = profiles.with_genre(base, "g", genres)
    assert out["source"] == {"official": True} and out["genre_source"] == {"client": "c"} and out["address"] == {"forbid_ssi": True, "other": 1} and "label" not in out
    assert [r["id"] for r in out["rules"]] == ["A", "G01"] and profiles.recommended_ms(out) == (None, 2000) and profiles.with_genre(base, None, genres) == base
    with pytest.raises(profiles.ProfileError):
        profiles.with_genre(base, "h", genres)


def test_spotting_takes_the_better_detector(spark):
    c = table(spark, "a", "b").unionByName(spark.createDataFrame([(2, 1, 2000, 3500, "c")], CUE))
    spans = spark.createDataFrame([(1, 2500, 3400, "vad"), (1, 100, 200, "loudness"), (2, 2500, 3400, "loudness")], "file_id long, start_ms long, end_ms long, method string")
    moved, found = jobs.spot_job(c, spans, apply=True)
    got = {(r.file_id, r.idx, r.field): r.suggested for r in found.collect()}
    assert got[(1, 1, "start_ms")] == 2417 and got[(2, 1, "start_ms")] == 2375 and (1, 2, "end_ms") not in got
    assert {(r.file_id, r.idx): r.start_ms for r in moved.collect()}[(1, 1)] == 2417


def test_what_passes_on_is_carried_along_a_run(spark):
    rng = random.Random(3)
    rows = [(f, p, rng.randrange(100), rng.random() < 0.6) for f in range(20) for p in range(1, 60)]
    out = moves.carried(spark.createDataFrame(rows, "file_id long, pos int, v long, h boolean"), F.col("h"), lambda x, before: F.coalesce(before, F.lit(0)) % 7 + x["v"], "before")
    got = {(r.file_id, r.pos): r.before for r in out.collect()}
    want, last = {}, None
    for f, p, v, h in rows:
        before = last if h and p > 1 else None
        want[(f, p)], last = before, (before or 0) % 7 + v
    assert got == want


def test_sheets_lists_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "deep").mkdir()
    for name in ("x.SRT", "y.vtt", "z.fixed.srt", "n.txt", "a/w.srt", "a/deep/v.srt"):
        (tmp_path / name).write_text("1")
    assert sorted(r.path.rsplit("/", 1)[1] for r in subtitles.list_subtitle_files(spark, str(tmp_path)).collect()) == ["w.srt", "x.SRT", "y.vtt"]
    pairs = spark.createDataFrame([("t1", 1), ("t2", 2)], "title string, n int")
    subtitles.write_json({"pairs": pairs, "stats": pairs.groupBy().count()}, str(tmp_path / "out"), "title")
    assert sorted(p.name for p in (tmp_path / "out" / "pairs").iterdir() if p.is_dir()) == ["title=t1", "title=t2"]
    assert spark.read.json(str(tmp_path / "out" / "stats")).first()["count"] == 2
