"""What grew faster than its input: pairs, keys and texts that a job need not make."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sottovoce.functions import split
from sottovoce.functions.similar import similarity, words_of
from sottovoce.functions.text import trimmed
from sottovoce.operators import checks, files, language, matching, names, proofread, reference_data, timing, tracks
from sottovoce.plans import jobs, reference_queries, source_queries
from sottovoce.plans.profiles import FULL
from sottovoce.sources import fixtures, subtitles


def _labelled(n: int, file_id: int) -> list[tuple]:
    """Turns of ``n`` speakers, each of whom names the next two."""
    return [(file_id, i + 1, i * 1000, i * 1000 + 900, f"[n{i}x] n{(i + 1) % n}x 님 n{(i + 2) % n}x") for i in range(n)]


def test_cross_reference_of_few_names_makes_no_keys(spark, monkeypatch):
    rows = _labelled(5, 1) + _labelled(3, 2)
    monkeypatch.setattr(names, "keys_in", lambda *a: 1 / 0)
    got = names.cross_reference(spark.createDataFrame(rows, "file_id long, idx int, start_ms long, end_ms long, text string")).collect()
    want = {(f, f"n{i}x", f"n{(i + d) % n}x", 1, ("님",) if d == 1 else ()) for f, n in ((1, 5), (2, 3)) for i in range(n) for d in (1, 2)}
    assert {(*r[:4], tuple(r.calls)) for r in got} == want


def test_cross_reference_of_many_names_equals_that_of_few(spark, monkeypatch):
    cues = spark.createDataFrame(_labelled(94, 1) + _labelled(4, 2), "file_id long, idx int, start_ms long, end_ms long, text string")
    each = lambda: sorted((*r[:4], *r.calls) for r in names.cross_reference(cues).collect())
    both = each()
    monkeypatch.setattr(names, "FEW_NAMES", 1000)
    assert both == each()
    assert len(both) == 2 * 98


def test_a_walk_compares_as_far_as_shared_words_leave_a_chance():
    rnd, window = random.Random(4), 6
    for _ in range(300):
        line = lambda: " ".join(rnd.choice("a b c d e f".split()) for _ in range(rnd.choice((0, 1, 2, 5, 9))))
        told, said, free = [line() for _ in range(rnd.randrange(12))], line(), rnd.randrange(4)
        ratios = [similarity(said, x) for x in told[free : free + window]] or [0.0]
        best, at = tracks._nearest([words_of(x) for x in told], window)(words_of(said), free)
        assert best == max(ratios) and (not best or at == free + ratios.index(best))


def test_a_walk_makes_few_comparisons(monkeypatch):
    made = []
    monkeypatch.setattr(tracks, "SequenceMatcher", lambda *a: made.append(a) or SequenceMatcher(*a))
    told = [[f"w{i}", f"v{i}", "the"] for i in range(50)]
    nearest, free = tracks._nearest(told, 6), 0
    for i in range(50):
        score, at = nearest([f"w{i}", f"v{i}"], free)
        free = at + 1
        assert (score, at) == (0.8, i)
    assert len(made) == 50  # one index a line, not one for each of 285 pairs


def test_glossaries_of_a_folder_are_not_paired_with_all_its_subtitles(spark):
    n = 3000
    paths = lambda form: spark.range(n).select(F.format_string(form, "id").alias("path"))
    got = subtitles.pair_glossary_with_subtitle(paths("/w/t%05d_TL.fixed.srt"), paths("/w/x t%05d KNP.xlsx").filter("path not like '%7 KNP%'"))
    assert "contains(book" not in got._jdf.queryExecution().executedPlan().toString().lower()
    rows = {r.path: r.book for r in got.collect()}
    assert len(rows) == n and all(b == (f"/w/x {p[3:9]} KNP.xlsx" if p[8] != "7" else "/w/x t00000 KNP.xlsx") for p, b in rows.items())


def test_a_glossary_does_not_name_a_subtitle_by_a_part_of_a_number(spark):
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    books = paths("/w/t100003 KNP.xlsx", "/w/t10000 KNP.xlsx", "/w/a12 KNP.xlsx", "/v/12KNP.xlsx", "/v/0 KNP.xlsx", "/t9/1 KNP.xlsx", "/t9/2 t9 KNP.xlsx")
    got = subtitles.pair_glossary_with_subtitle(paths("/w/t10000_TL.srt", "/w/t1000.srt", "/w/2.srt", "/w/t100003.srt", "/v/12.srt", "/v/1.srt", "/t9/t9.srt"), books)
    first = {"/w": "/w/a12 KNP.xlsx", "/v": "/v/0 KNP.xlsx"}
    assert {r.path: r.book for r in got.collect()} == {
        "/w/t10000_TL.srt": "/w/t10000 KNP.xlsx", "/w/t1000.srt": first["/w"], "/w/2.srt": first["/w"], "/w/t100003.srt": "/w/t100003 KNP.xlsx",
        "/v/12.srt": "/v/12KNP.xlsx", "/v/1.srt": first["/v"], "/t9/t9.srt": "/t9/2 t9 KNP.xlsx",
    }


def test_glossary_of_subtitle_equals_its_sql_beyond_five_digits(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    ids = [*range(120), *range(12340, 12360), *range(123400, 123600)]
    spark.createDataFrame([(i, "one two") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = set(db.sql(source_queries.ORACLE["glossary_of_subtitle"]).fetchall())
    assert {tuple(r) for r in source_queries.QUERIES["glossary_of_subtitle"](spark, str(tmp_path)).collect()} == want


def test_candidates_are_scored_once_and_numbered_in_one_pass(spark):
    cols = "file_id long, o_idx int, t_idx int, turn struct<a: long, b: int>, wish struct<s: double, a: long, b: int>, score double"
    rows = [(1, o, t, (t * 10, t), (-1.0, o * 10, o), 1.0) for o, t in ((1, 1), (2, 1), (2, 2), (4, 3), (5, 4), (4, 4), (9, 6))]
    got = matching.with_islands(spark.createDataFrame(rows, cols))
    islands = {}
    for r in got.collect():
        islands.setdefault(r.island, set()).add((r.o_idx, r.t_idx))
    assert sorted(map(sorted, islands.values())) == [[(1, 1), (2, 1), (2, 2)], [(4, 3), (4, 4), (5, 4)], [(9, 6)]]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_cues_are_shuffled_with_one_text(spark, tmp_path):
    texts = [(7, "\n".join(f"line {i} " + "x" * (i % 90) for i in range(500))), (8, ""), (9, None), (10, "one")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cues = fixtures.cues(spark, str(tmp_path))
    node = cues._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    dealt = node.children().head().output().mkString(",")
    assert [c.split("#")[0] for c in dealt.split(",")] == ["file_id", "idx", "text", "step", "dur"]
    rows = {(r.file_id, r.idx): r for r in cues.collect()}
    assert {f for f, _ in rows} == {7, 10}
    for file_id, text in ((7, texts[0][1]), (10, "one")):
        pieces, end = [p.strip() for x in text.split("\n") for p in re.findall("(?s).{1,60}", x.strip()) if p.strip()], 1000
        assert len(pieces) == sum(f == file_id for f, _ in rows)
        for i, p in enumerate(pieces, 1):
            dur = 300 + (len(p) * 37 + i * 101) % 8200
            end += (i * 7919 + file_id * 104729) % 1500 - 300 + dur
            assert (rows[file_id, i].start_ms, rows[file_id, i].end_ms) == (end - dur, end)


def test_glossaries_are_searched_for_without_rows_of_keys(spark, monkeypatch):
    monkeypatch.setattr(language, "keys_in", lambda *a: 1 / 0)
    rnd, letters = random.Random(5), "ab Ab\u00e9\u00c9_-'.\n가"
    text = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randrange(n)))
    rows = [(1, i, text(40), rnd.choice(["x", "xy", "z", None])) for i in range(300)] + [(2, 1, None, "x"), (2, 2, "", "x")]
    terms = sorted({(text(5), rnd.choice("xyz")) for _ in range(400)} | {("", "x"), ("a", "")})
    for most in (5, len(terms)):
        chosen = terms[:most]
        want = {}
        for f, i, s, t in rows:
            said = {f"{a} -> {b}" for a, b in chosen if a and b and s is not None and t is not None and a.lower() in s.lower() and b not in t}
            if said:
                want[f, i] = sorted(said)
        got = language.glossary_misses(spark.createDataFrame(rows, "file_id long, idx int, source string, target string"), spark.createDataFrame(chosen, "term string, korean string"))
        assert {(r.file_id, r.idx): r.missed for r in got.collect()} == want
        assert "Exchange hashpartitioning(file_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_long_and_short_glossaries_miss_the_same_whole_words(spark, monkeypatch):
    rows = [(1, i, s, "그") for i, s in enumerate(["The end", "bathe the-cat", "it_the", "éthe", "C++ is", "ok. Go", "no", "a b  c"])]
    pairs = spark.createDataFrame(rows, "file_id long, idx int, source string, target string")
    glossary = spark.createDataFrame([("the", "것"), ("c++", "씨"), ("is", "그"), ("ok. go", "가"), ("b", "비"), ("...", "점")], "term string, korean string")
    few = sorted(map(tuple, language.glossary_misses(pairs, glossary, whole_words=True).collect()))
    monkeypatch.setattr(language, "FEW_TERMS", 0)
    assert few == sorted(map(tuple, language.glossary_misses(pairs, glossary, whole_words=True).collect()))
    assert few and [r[1] for r in language.translation_flags(pairs, glossary, ("glossary",)).select("file_id", "idx").collect()]


def test_a_corrector_gets_batches_of_files(spark):
    cues = spark.createDataFrame([(f, i, f"[x] a{f}  b{i}") for f in (1, 2, 3) for i in (2, 1, 10)], "file_id long, idx int, text string")
    seen = lambda texts: (["|".join(texts)] + texts[1:], [{"line_index": 2, "reason": "r"}, {"line_index": 9, "reason": "far"}])
    got = proofread.corrected(cues, seen)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.file_id, r.idx): (r.after, [f.reason for f in r.flags]) for r in got.collect()}
    for f in (1, 2, 3):
        said = [f" a{f}  b{i}" for i in (1, 2, 10)]
        assert [rows[f, i] for i in (1, 2, 10)] == [("|".join(said), []), (said[1], ["r"]), (said[2], [])]


def test_plain_texts_are_not_measured_by_patterns_for_each_character(monkeypatch):
    class Never:
        def __getattr__(self, name):
            raise AssertionError(name)

    monkeypatch.setattr(split, "_WIDE", Never())
    assert split.pieces("one two, three four five", 10) == ["one two,", "three", "four five"]


def test_values_of_an_infobox_are_read_once_and_only_for_marks_they_have(monkeypatch):
    read, plain = [], reference_data._readable
    monkeypatch.setattr(reference_data, "_readable", lambda v: read.append(v) or plain(v))
    assert reference_data._fields("{{Infobox c | a = x | b = [[l|y]] {{t|z}} | c = <ref/> }}") == {"a": "x", "b": "y z"}
    assert len(read) == 3
    assert reference_data._fields("{{Infobox c}} none") == {}


def test_a_round_of_revision_joins_once(spark, monkeypatch):
    plans, write = [], jobs.scratch
    monkeypatch.setattr(jobs, "scratch", lambda d, name: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or write(d, name))
    cues = spark.createDataFrame([(1, 1, "a  b"), (1, 2, "c"), (1, 3, None)], "file_id long, idx int, text string")
    out, changed, end = jobs.revision_rounds(cues, lambda c: c.filter("idx <> 2").withColumn("text", F.replace("text", F.lit("  "), F.lit(" "))))
    assert sorted((r.idx, r.text) for r in out.collect()) == [(1, "a b"), (2, "c"), (3, None)]
    assert (changed, end) == ([1, 0], "settled") and [p.count("Join ") for p in plans] == [1, 1]


def test_checks_measure_a_text_once_and_move_no_text(spark):
    cues = spark.createDataFrame([(1, 1, 0, 1000, "“[a] b. c”　"), (1, 2, 500, 900, "{\\an8}x"), (1, 3, 950, 990, None)], "file_id long, idx int, start_ms long, end_ms long, text string")
    speed = checks.findings(cues, FULL, ["reading_speed_exceeded", "optimal_cps_exceeded"])._jdf.queryExecution().optimizedPlan().toString()
    assert speed.count("octet_length") <= 4
    found = files.position_collides_with_forced_narrative(cues, {"marker": "double_quote", "policy": "move_dialogue", "move_to": "top_left"})
    assert [(r.idx, r.detail) for r in found.collect()] == [(2, "화면자막(1번)과 겹칩니다 — 말자막을 좌측 상단으로")]
    node = found._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "text#" not in node.left().output().mkString(",")
    # A missing text takes no other finding with it.
    assert {r.check for r in checks.findings(cues, FULL, ["duration_out_of_range", "line_length_exceeded"]).filter("idx = 3").collect()} == {"duration_out_of_range"}


def test_trimming_cuts_what_patterns_call_blank(spark):
    chars = spark.range(1, 0x10000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    text = F.concat("c", F.lit("\n"), "c", F.lit("a"), "c", F.lit("b"), "c", F.lit(" "))
    assert chars.filter(trimmed(text) != F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).count() == 0 and chars.count() > 60000


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_merging_and_translating_shuffle_texts_once(spark):
    cues = spark.createDataFrame([(f, i, i * 1000, i * 1000 + 900, f"t{i}\nu") for f in (1, 2) for i in range(1, 40)] + [(3, 1, 0, 1, None)], "file_id long, idx int, start_ms long, end_ms long, text string")
    assert _exchanges(timing.merge_fragments(cues)) == 1
    out, flags = jobs.translate_job(cues, lambda lines: lines.upper() + "\n13) again\nmore")
    assert _exchanges(out) == _exchanges(flags) == 1
    rows = {(r.file_id, r.idx): (r.start_ms, r.text, r.kept_source) for r in out.collect()}
    assert rows[2, 13] == (13000, "again\nmore", False) and rows[2, 39][1:] == ("T39 U\n13) again\nmore", False) and rows[3, 1] == (0, None, True) and len(rows) == 79


def test_replies_are_read_in_their_rows_as_by_joins(spark):
    rnd = random.Random(6)
    piece = lambda: rnd.choice(["1.", "2)", " 03 : ", "4", "99.", "9999999999.", "a", " b ", "\n", "\n", "\n", "\r\n", "\r", " ", "　", "1", "٢."])
    replies = [(n, "".join(piece() for _ in range(rnd.randrange(20)))) for n in range(300)]
    joined = language.parse_numbered_reply(spark.createDataFrame(replies, "batch int, reply string"), spark.createDataFrame([(n, i) for n in range(300) for i in (1, 2, 3, 4)], "batch int, idx int"))
    want = {(r.batch, r.idx): r.text for r in joined.collect()}
    assert {(n, i): t for n, x in replies for i, t in language.numbered_texts(x, range(1, 5)).items()} == want and len(want) > 100


def test_names_make_patterns_only_where_they_lie_in_longer_ones(spark):
    cues = spark.createDataFrame([(1, i, t) for i, t in enumerate(["go to Ivo Vann and Ivo Vann Lund", "see Vann", "an Ivo-Maria, Ivo", "FBI or Lun"], 1)], "file_id long, idx int, text string")
    got = names.term_extract(cues)
    assert {r.term for r in got.collect()} == {"Ivo Vann Lund", "Ivo-Maria", "FBI", "Lun"}
    assert "contains(longer#" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_terms_are_extracted_once_for_their_look_up(spark, monkeypatch):
    cues = spark.createDataFrame([(1, 1, "go to Ivo Vann"), (2, 1, "FBI")], "file_id long, idx int, text string")
    none = spark.createDataFrame([], "source string, korean string, pos int, title string, target string")
    got = jobs.terms_job(cues, spark.createDataFrame([("FBI", "연방")], "term string, korean string"), none.select("source", "korean", "pos"), none.select("title", "target"))
    assert {(r.file_id, r.term, r.korean, r.origin) for r in got.collect()} == {(1, "Ivo Vann", None, None), (2, "FBI", "연방", "glossary")}
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_makes_its_cues_and_findings_once(spark, tmp_path):
    texts = [(7, "\n".join(f"line {i}  " + "가" * (i % 50) for i in range(40))), (8, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = reference_queries.report_text(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 0 and plan.count("CPS — 최대") == 1 and "cell" not in plan
    reports = {r.file_id: r.report for r in got.collect()}
    assert set(reports) == {7, 8} and "위반 없음" in reports[8]
    said = [x for x in reports[7].split("\n") if x.startswith(("  [자동]", "  [확인]"))]
    counted = [int(x.split("건")[0]) for x in reports[7].split("규칙별 집계\n")[1].split("\n\n")[0].split("\n")]
    assert len(said) == sum(counted) > 0 and f"  위반 {len(said)}건" in reports[7] and counted == sorted(counted, reverse=True)


def test_what_speech_overlaps_a_cue_is_found_without_pairs(spark):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.choice([-5, 0, 1, 3, 20, 90])))(rng.randrange(200))
    cues = [(f, i, *span()) for f in (1, 2) for i in range(60)] + [(3, 1, 5, 9), (4, 1, None, 9), (4, 2, 3, None)]
    speech = [(f, *span()) for f in (1, 2) for _ in range(25)] + [(4, 0, 50), (4, None, 7), (4, 2, None), (5, 0, 9)]
    c, s = spark.createDataFrame(cues, "file_id long, idx int, start_ms long, end_ms long"), spark.createDataFrame(speech, "file_id long, start_ms long, end_ms long")
    heard = timing._heard(c, s)
    plan = heard._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {(r.file_id, r.idx): (r.voice, r.quiet) for r in heard.collect()}
    assert len(got) == len(cues)
    for f, i, start, end in cues:
        met = [(a, b) for g, a, b in speech if g == f and None not in (a, b, start, end) and a < end and b > start]
        assert got[f, i] == (min((a for a, _ in met), default=None), max((b for _, b in met), default=None))
