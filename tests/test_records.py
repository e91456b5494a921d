"""Stage stores, cast sheets and documents, evaluations, wiki fields, revision rounds and names within names."""

import json

import pytest
from pyspark.sql import functions as F
from sottovoce.operators import files, names, reference_data
from sottovoce.plans import jobs
from sottovoce.plans.profiles import FULL
from sottovoce.sources import sheets, stage_store

CUES = "file_id long, idx int, start_ms long, end_ms long, text string"


def cues(spark, *rows):
    return spark.createDataFrame(list(rows), CUES)


def test_stage_store_records_steps_and_goes_on_from_the_last(spark, tmp_path):
    store = stage_store.StageStore(spark, str(tmp_path / "store"))
    assert store.steps().count() == 0 and store.read_source().count() == 0
    draft = cues(spark, (1, 1, 0, 10, "a"), (1, 2, 20, 30, "b"), (2, 1, 0, 5, "c"))
    store.save(draft, "draft", model="m", seconds=2.0)
    store.save(cues(spark, (1, 1, 0, 10, "A"), (1, 2, 21, 30, "B")), "timing")
    # The same step again takes its place; the file that is not in it keeps its record.
    store.save(cues(spark, (1, 1, 0, 10, "A!"), (1, 2, 20, 30, "B!")), "timing", note="again")
    store.save(cues(spark, (1, 1, 0, 10, "A!")), "cut")
    got = {(r.file_id, r.step): (r.seq, r.cues, r.moved_count, list(r.moved), r.note) for r in store.steps().collect()}
    assert got == {(1, "draft"): (1, 2, 0, [], ""), (2, "draft"): (1, 1, 0, [], ""), (1, "timing"): (2, 2, 0, [], "again"), (1, "cut"): (3, 1, 1, [], "")}
    assert sorted(r.text for r in store.read("timing").collect()) == ["A!", "B!"]
    assert {r.file_id: r.step for r in store.last().collect()} == {1: "cut", 2: "draft"}
    assert sorted((r.file_id, r.step, r.text) for r in store.resume().collect()) == [(1, "cut", "A!"), (2, "draft", "c")]
    text = {r.file_id: r.summary for r in stage_store.summary(store).collect()}
    assert text[2] == "draft 자막 1개 · m · 2.0초" and "[경고] 타임코드가 1곳" in text[1]
    # A step without a record, as a run that died leaves it, is not a step.
    draft.write.parquet(str(tmp_path / "store/steps/step=lost/save=x"))
    assert {r.step for r in store.last().collect()} == {"cut", "draft"} and store.read("lost").count() == 0
    store.save_source(draft)
    store.save_source(draft.filter("file_id = 2"))
    assert [tuple(r) for r in store.read_source().collect()] == [(2, 1, "c")]


def test_stage_store_deals_times_by_file_once_and_hands_on_what_it_kept(spark, tmp_path):
    store = stage_store.StageStore(spark, str(tmp_path / "store"))
    rows = [(1, i, 10 * i, 10 * i + 5, "a") for i in range(1, 31)]
    kept = store.save(cues(spark, *rows), "draft")
    assert sorted(map(tuple, kept.collect())) == rows and kept.inputFiles()
    # The second file comes later; the first save of each file is what later ones are held against.
    moved = kept.withColumn("end_ms", F.col("end_ms") + (F.col("idx") > 3).cast("int")).unionByName(cues(spark, (2, 7, 0, 5, "b"), (2, 9, 6, 9, "b"), (None, 1, 0, 1, "x")))
    store.save(moved, "timing")
    store.save(cues(spark, (2, 7, 0, 5, "b"), (2, 9, 6, 8, "b"), *rows[:2], (1, 4, 30, 35, "a")), "cut")
    store.save(kept.limit(0), "none")
    got = {(r.file_id, r.step): (r.seq, r.cues, r.moved_count, list(r.moved)) for r in store.steps().collect()}
    assert got == {(1, "draft"): (1, 30, 0, []), (1, "timing"): (2, 30, 27, list(range(4, 24))), (2, "timing"): (1, 2, 0, []), (1, "cut"): (3, 3, 27, [4]), (2, "cut"): (2, 2, 1, [9])}
    times = stage_store._times(kept, 1).unionByName(stage_store._times(moved, 2))
    plan = stage_store._compared(times, 2)._jdf.queryExecution().executedPlan().toString()
    assert times.columns == ["file_id", "nth", "idx", "start_ms", "end_ms"] and plan.count("Exchange") == 1 and "Join" not in plan


def test_cast_sheets_are_read_by_their_headers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿나이\t이름\t말투 지정\t관계\t대사 수\n42\t민수\t격 식\t영희: 동료; 철수:;:x;영희:상사\t7\n확인 필요\t-\t해요체\t\t\n\n정해 주세요\t영희\t이상\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("이름\t대사 수\t관계\n철수\tmany\t-\n", encoding="utf-8")
    got = {r.speaker: r for r in sheets.read_cast_sheets(spark, str(tmp_path)).collect()}
    assert set(got) == {"민수", "영희", "철수"}
    m = got["민수"]
    assert (m.age, m.tone, m.relations, m.lines, m.job) == ("42", "합니다체", {"영희": "상사"}, 7, "")
    assert (got["영희"].age, got["영희"].tone, got["영희"].relations, got["철수"].lines) == ("", "", {}, 0)


def test_cast_documents(spark):
    c = cues(spark, (1, 1, 0, 1, "[민수] 영희 씨, 갑니다."), (1, 2, 2, 3, "[영희] 가요."), (1, 3, 4, 5, "누구세요"))
    job = jobs.cast_job(c)
    sheet = spark.createDataFrame([(1, "민수", "형사", "http://x/p.png", {"영희": "동료"})], "file_id long, speaker string, job string, photo string, relations map<string,string>")
    (r,) = sheets.cast_markdown(job["people"], job["relations"], job["untagged"], sheet).collect()
    for line in ("인물 2명 · 화자 표시가 붙은 자막 2개", "화자를 모르는 자막 1개는", "## 민수", "![민수](http://x/p.png)", "라이선스: 확인 필요", "- 말투: 합니다체 (합니다체 1 / 해요체 0, 합니다체 100%, 유보 0)", "- 부르는 호칭: 영희에게 '씨'", "- 관계: 영희: 동료", "- 직업: 형사", "- 아직 빈 항목: 성별, 나이, 경력, 성격", "요약이므로"):
        assert line in r.markdown, line
    assert r.markdown.index("## 민수") < r.markdown.index("## 영희") and "- 관계: 확인 필요" in r.markdown


def test_evaluations_as_files(spark, tmp_path):
    ours = cues(spark, (1, 1, 155, 1000, "go home now"), (1, 2, 2155, 3000, "yes we do"), (1, 3, 90000, 91000, "extra"))
    truth = cues(spark, (1, 1, 0, 1000, "go home now"), (1, 2, 2000, 3000, "yes we do it"), (1, 3, 50000, 51000, "missing"), (2, 1, 0, 9, "alone"))
    out = jobs.evaluation(ours, truth, note="n")
    s = {r.file_id: r for r in out["summary"].collect()}
    assert (s[1].ours, s[1].truth, s[1].matched, s[1].missing, s[1].extra, s[1].start_diff_median, s[1].our_duration) == (3, 3, 2, 1, 1, 155, 845)
    assert (s[2].ours, s[2].matched, s[2].missing) == (0, 0, 1)
    sheets.write_titles(out["files"], str(tmp_path / "t"), "json")
    read = {r.file_id: json.loads(r.value) for r in sheets.read_titles(spark, str(tmp_path / "t")).collect()}
    assert set(read) == {1, 2} and read[1]["note"] == "n" and read[1]["summary"]["matched"] == 2
    assert [(p["truth_index"] if "truth_index" in p else p["truth_idx"], p["ours_idx"], p["start_diff"], p["similarity"]) for p in read[1]["pairs"]] == [(1, 1, 155, 1.3), (2, 2, 155, 1.157), (3, None, None, 0.0), (None, 3, None, 0.0)]


PAGE = """{{Character Infobox
|title = Walter White
|occupation = [[Chemistry|Chemistry]] teacher<br />Meth '''manufacturer'''
|affiliation = {{Plainlist|
* [[Gray Matter]]
* [[Los Pollos Hermanos]]
}}
|family = [[Skyler White|Skyler]] (wife)<ref>{{cite web|url=http://x|title=y}}</ref>
|empty =
| = nothing
|nested = {{a|b {{c|d|k=v}}}} end
|status = Deceased
}}
'''Walter''' was a teacher. | not = a field
"""


def test_infobox_of_any_name_with_inner_templates(spark):
    pages = [(0, PAGE), (1, "{{Infobox character|name=Ann|x}}"), (2, "no box {{x|a=b}}"), (3, None), (4, "{{Infobox|a={{b|c"), (5, "{{infobox|k={{a|b}}|k=[[l|m|n]]|v={{" + "a|" * 20000 + "}}}}")]
    got = {r.i: r.f for r in spark.createDataFrame(pages, "i int, page string").select("i", reference_data.infobox(F.col("page")).alias("f")).collect()}
    assert got[0] == {"title": "Walter White", "occupation": "Chemistry teacher Meth manufacturer", "affiliation": "Gray Matter / Los Pollos Hermanos", "family": "Skyler (wife)", "nested": "b d end", "status": "Deceased"}
    assert got[1] == {"name": "Ann"} and got[2] == {} and not got[3] and got[5]["v"].startswith("a a")


def test_rounds_of_what_changed_equal_rounds_of_everything(spark):
    rows = [(1, i, 0, 1, "a" + " " * (i % 6) + "b" + "  c" * (i % 3)) for i in range(30)] + [(1, 99, 0, 1, "x")]

    def once(text):
        return text + text * 3 if text == "x" else text.replace("  ", " ", 1)

    seen = []

    def revise(d):
        seen.append(d.count())
        return d.withColumn("text", F.when(F.col("text") == "x", F.repeat("text", 4)).otherwise(F.regexp_replace("text", "^(.*?)  ", "$1 ")))

    out, changed, end = jobs.revision_rounds(cues(spark, *rows), revise, most=9)
    first, counts = {r[1]: r[4] for r in rows}, []
    want = dict(first)
    off = lambda new, old: not 1 / 1.5 <= len(new) / len(old) <= 1.5
    while not counts or counts[-1]:
        new = {i: t if off(once(t), t) or off(once(t), first[i]) else once(t) for i, t in want.items()}
        counts.append(sum(new[i] != want[i] for i in want))
        want = new
    assert {r.idx: r.text for r in out.collect()} == want and changed == counts and end == "settled"
    assert seen == [31, *counts[:-1]]
    assert jobs.revision_rounds(cues(spark, *rows), revise, most=1)[1:] == ([counts[0]], "cap")


def test_effect_hints_stand_behind_the_marker(spark):
    c = cues(spark, (1, 1, 0, 1, "[문이 닫히는 소리] 가자"), (1, 2, 2, 3, "[이상한 소리]"))
    found = jobs.checks.findings(c, FULL, ["discouraged_sound_ending"]).select("file_id", "idx", "detail")
    lexicon = spark.createDataFrame([("문", "[문이 닫힌다]"), ("차", "[자동차 경적]")], "category string, term string")
    got = {r.idx: r.detail for r in reference_data.with_effect_hints(found, lexicon).collect()}
    assert got == {1: "[문이 닫히는 소리] — 이렇게 쓸 수 있습니다: [문이 닫힌다]", 2: "[이상한 소리]"}


@pytest.mark.parametrize("n", [1, 60])
def test_labels_within_labels(spark, n):
    labels = [f"p{i}" for i in range(n)] + ["김 경위", "경위", "경위 2", "김경위", "a", "Ann Lee", "Ann"]
    rows = [(1, i, i, i, f"[{x}] hello") for i, x in enumerate(labels, 1)]
    got = {(r.idx, r.detail.split("가 같은")[0]) for r in files.speaker_id_inconsistent(cues(spark, *rows)).filter("detail like '%통일해야%'").collect()}
    base = lambda x: __import__("re").sub(r"\s*\d+$", "", x).replace(" ", "")
    want = set()
    for i, a in enumerate(labels):
        for j in range(i + 1, len(labels)):
            x, y = base(a), base(labels[j])
            if x and y and x != y and (x in y or y in x):
                want.add((j + 1, f"[{a}]와 [{labels[j]}]"))
    assert got == want


def test_who_names_whom(spark):
    c = cues(spark, (1, 1, 0, 1, "[Ann] Hello Bob Stone 씨"), (1, 2, 2, 3, "[Bob Stone] An Anna"), (2, 1, 0, 1, "[Bob Stone] Ann"))
    got = {(r.file_id, r.speaker, r.other, r.mentions, tuple(r.calls)) for r in names.cross_reference(c).collect()}
    assert got == {(1, "Ann", "Bob Stone", 1, ("씨",)), (1, "Bob Stone", "Ann", 1, ())}
