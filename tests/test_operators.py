"""Literal cases for the timed-text operators; those with lookarounds have no SQL to compare with."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from sottovoce.functions.similar import similarity
from sottovoce.functions.split import pieces
from sottovoce.functions.text import formality_level, one_decimal, quoted, topic_particle, weighted_chars
from sottovoce.operators import checks, files, fixes, language, timing, tracks
from sottovoce.plans import jobs, profiles
from sottovoce.sources import subtitles

CUE = "file_id long, idx int, start_ms long, end_ms long, text string"


def cue_table(spark, *texts, length=3000):
    return spark.createDataFrame([(1, i + 1, i * 5000, i * 5000 + length, t) for i, t in enumerate(texts)], CUE)


def fired(spark, name, *texts, profile=profiles.FULL):
    found = checks.findings(cue_table(spark, *texts), profile, [name])
    return sorted({r.idx for r in found.collect()})


LOOKAROUND = {
    "currency_bul": (["20만 불 벌었어", "3천 불을 줘", "5불짜리"], ["불이 났다", "불빛"]),
    "hangul_clock": (["아홉 시에 봐", "열두 시"], ["세 시간", "다시 와"]),
    "hangul_number_ten_plus": (["열다섯 명", "스물 개"], ["다섯 명", "열심히"]),
    "colon_speaker_prefix": (["SARAH: Come in", "화자1: 왜 이래", "- Tom Lee: no"], ["9:30에 봐", "He said 9:30"]),
    "honorific_ssi_used": (["민수 씨, 가요"], ["한 씨앗", "[민수 씨] 네", "그 씨"]),
    "ampersand_outside_initialism": (["밥 & 국", "a&B"], ["R&B"]),
    "middle_initial_period": (["John F. Kennedy"], ["끝. 시작", "F.x"]),
    "bleep_mask_character": (["이런 OO같은"], ["OK 알았어", "**같은"]),
    "full_bleep_style": (["** *** **"], ["**"]),
    "range_notation": (["6만 ~ 8만 명", "6~8만 명"], ["6만~8만 명"]),
    "line_break_position": (["내가 하는\n것이야", "그\n사람", "먹고\n있다", "왔던\n길"], ["척 파머\n왔다", "하나\n- 둘", "한 줄"]),
    "speaker_id_conjunction": (["[철수와 영희] 가자"], ["[철수, 영희] 가자"]),
    "lyric_line_not_capitalized": (["♪ hello ♪"], ["♪ Hello ♪"]),
    "effect_after_dialogue": (["가자 [문소리]"], ["[철수] [문소리]", "[문소리]"]),
    "speaker_id_alone_on_line": (["[철수]\n가자"], ["[철수] 가자", "[소리]\n[다른 소리]"]),
    "em_or_en_dash": (["가자 – 응"], ["가자 - 응"]),
    "unit_composed_character": (["5㎏"], ["5kg"]),
}


@pytest.mark.parametrize("name", LOOKAROUND)
def test_check_fires_where_it_should(spark, name):
    yes, no = LOOKAROUND[name]
    assert fired(spark, name, *yes, *no) == list(range(1, len(yes) + 1))


def test_a_profile_without_a_limit_switches_the_check_off(spark):
    assert checks.CHECKS["line_length_exceeded"]({}) is None and checks.CHECKS["too_many_lines"]({"limits": {"max_lines": 0}}) is None


def test_expressions(spark):
    df = spark.createDataFrame([("가나 ab",), ("<i>가</i>\n{\\an8}나",)], "t string").select(weighted_chars(F.col("t"), 1.0, 0.5).alias("n"))
    assert [r.n for r in df.collect()] == [3.5, 2.0]
    levels = spark.createDataFrame([("갑니다.",), ("가요?",), ("뭐야",), ("가십시오!",), ("[소리]",), ("아니다",)], "t string").select(formality_level(F.col("t")).alias("l"), topic_particle(F.col("t")).alias("p"))
    assert [r.l for r in levels.collect()] == ["합니다체", "해요체", None, "합니다체", None, None]
    assert similarity("Hello there", "hello") == pytest.approx(2 / 3) and similarity("", "a") == 0


FIXED = {
    "currency_bul": [("3천 불을 줘", "3천 달러를 줘"), ("불이 났다", "불이 났다"), ("5불짜리", "5 달러짜리")],
    "colon_speaker_prefix": [("SARAH: Come in", "(Sarah) Come in"), ("화자1: 왜", "(화자1) 왜"), ("9:30", "9:30")],
    "acronym_with_periods": [("J.F.K. 공항과 U.S.", "JFK 공항과 US")],
    "space_between_markers": [("(철수) [작게] 왜", "(철수)[작게] 왜"), ("[소리] [소리]", "[소리] [소리]")],
    "dual_speaker_marker_format": [("-가\n--나", "- 가\n--나")],
    "line_end_period_or_comma": [("끝.\n계속...", "끝\n계속...")],
}


@pytest.mark.parametrize("name", FIXED)
def test_fix(spark, name):
    out = fixes.fix_text(cue_table(spark, *[a for a, _ in FIXED[name]]), profiles.FULL, [name]).orderBy("idx").collect()
    assert [r.text for r in out] == [b for _, b in FIXED[name]]


def test_check_after_fix_and_unfixable_names(spark):
    profile = {**profiles.FULL, "rules": [{"id": "A1", "check": "three_dot_ellipsis", "auto": True}, {"id": "A2", "check": "tilde_used", "auto": True}]}
    assert fixes.fix_names(profile) == (["three_dot_ellipsis"], ["A2 (tilde_used)"])
    fixed, found = jobs.correct_and_check(cue_table(spark, "음... 그래~"), profile)
    assert fixed.first().text == "음… 그래~" and "ellipsis_style_mismatch" not in {r.check for r in found.collect()}


def test_profiles_merge_and_refuse():
    base = {"schema_version": 1, "platform": "p", "kind": "common", "status": "complete", "source": {"client": "s"}, "limits": {"a": 1, "b": 2}, "rules": [{"id": "R1", "check": "x"}, {"id": "R2", "check": "y"}]}
    child = {**base, "kind": "sdh", "extends": "base", "limits": {"b": 3}, "rules": [{"id": "R1", "check": "z"}], "disable_rules": ["R2"]}
    out = profiles.resolve("child", {"base": base, "child": child})
    assert out["limits"] == {"a": 1, "b": 3} and [r["check"] for r in out["rules"]] == ["z"]
    profiles.validated(out)
    with pytest.raises(profiles.ProfileError):
        profiles.resolve("a", {"a": {**base, "extends": "b"}, "b": {**base, "extends": "a"}})
    for broken in ({"status": "draft"}, {"schema_version": 2}, {"kind": "translation", "speaker_id": {}}, {"source": None}, {"source": {"note": "x"}}, {"kind": "template"}, {"kind": "common"}):
        with pytest.raises(profiles.ProfileError):
            profiles.validated({**out, **broken})


def test_merge_fragments_stops_at_the_cap(spark):
    rows = [(1, 1, 0, 1000, "a"), (1, 2, 1100, 2000, "b"), (1, 3, 2100, 4200, "c"), (1, 4, 5000, 6000, "d"), (1, 5, 5900, 6100, "e")]
    out = timing.merge_fragments(spark.createDataFrame(rows, CUE)).orderBy("idx").collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.text) for r in out] == [(1, 0, 2000, "a b"), (2, 2100, 4200, "c"), (3, 5000, 6000, "d"), (4, 5900, 6100, "e")]


def test_converge_moves_and_reports(spark):
    limits = {"least": 833, "most": 7000, "gap": 83, "cps": 14, "wide": 1.0, "other": 0.5}
    rows = [(1, 1, 0, 2500, "가"), (1, 2, 2000, 3000, "나"), (1, 3, 3050, 3100, "다"), (1, 4, 20000, 30000, "라"), (1, 5, 40000, 41000, "가" * 28)]
    out = timing.converge(spark.createDataFrame(rows, CUE), limits).collect()
    cues = {r.idx: (r.start_ms, r.end_ms) for r in out if r.kind == "cue"}
    assert cues == {1: (0, 1917), 2: (2000, 2967), 3: (3050, 3883), 4: (20000, 27000), 5: (40000, 42000)}
    assert not [r for r in out if r.kind == "unresolved"]


def test_positions_move_only_when_decided(spark):
    rows = [(1, 1, 0, 2000, '"간판"'), (1, 2, 1000, 3000, "대사"), (1, 3, 5000, 6000, "{\\an8}위")]
    c = spark.createDataFrame(rows, CUE)
    got = {r.idx: r.action for r in files.position_suggestions(c, files.job_rules(profiles.FULL)).collect()}
    assert got == {2: "move", 3: "reset"}
    assert files.position_suggestions(c, files.job_rules({})).count() == 0
    moved = {r.idx: r.text for r in files.apply_positions(c, files.position_suggestions(c, files.job_rules(profiles.FULL))).collect()}
    assert moved == {1: '"간판"', 2: "{\\an8}대사", 3: "위"}


def test_resplit_cuts_at_sentences(spark):
    assert pieces("First one here. Second one there.", 20) == ["First one here.", "Second one there."]
    assert pieces("x" * 50, 20) == ["x" * 50]
    c = spark.createDataFrame([(1, 1, 0, 4000, "First one here. Second one there.")], CUE)
    out = timing.resplit_cues(c, {"limits": {"chars_per_line": 20, "max_lines": 1}}).orderBy("idx").collect()
    assert [(r.idx, r.start_ms, r.end_ms) for r in out] == [(1, 0, 1875), (2, 1875, 4000)]


def test_one_decimal_follows_the_binary_value(spark):
    values = [10.35, 10.45, 11.65, 0.25, 0.35, 0.05, 10.3, 99.95, 12345.65, 7.0, 14 / 3, 0.0, 1e-9] + [k / 20 for k in range(1, 200, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", one_decimal(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == {v: f"{v:.1f}" for v in values}
    said = ["it's", 'a "b"', "x", "it's \"b\"", "back\\slash"]
    assert [r.s for r in spark.createDataFrame([(x,) for x in said], "x string").select(quoted(F.col("x")).alias("s")).collect()] == [repr(x) for x in said]


def test_resplit_never_makes_cues_without_length(spark):
    """One silence near two bounds: the first takes it, the second stays; shares are laid on rounded bounds."""
    c = spark.createDataFrame([(1, 1, 0, 3000, "aaaa aaaa aaaa"), (1, 2, 4000, 4001, "x" * 9)], CUE)
    speech = spark.createDataFrame([(1, 0, 1400), (1, 1600, 3000)], "file_id long, start_ms long, end_ms long")
    out = timing.resplit_cues(c, {"limits": {"chars_per_line": 4, "max_lines": 1}}, speech, tolerance_ms=600).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in out] == [(0, 1500, "aaaa"), (1500, 2000, "aaaa"), (2000, 3000, "aaaa"), (4000, 4001, "x" * 9)]


def test_spans_meet_once_across_cells(spark):
    rows = [(1, i, 5000 * i, 5000 * i + 21_000, "t") for i in range(12)] + [(2, 1, 0, 40_000, "t")]
    c = spark.createDataFrame(rows, CUE)
    got = sorted((r.file_id, r.a_idx, r.b_idx) for r in files.overlap_join(c, c).collect())
    assert got == sorted((f, i, j) for f, i, a, b, _ in rows for g, j, x, y, _ in rows if f == g and a < y and x < b)


def test_alignment_follows_the_script(spark):
    segments = spark.createDataFrame([(1, 1, 0, 1000, "hello there friend"), (1, 2, 1000, 2000, "something else"), (1, 3, 2000, 3000, "goodbye now")], CUE)
    script = spark.createDataFrame([(1, 0, "Hello there, friend."), (1, 1, "Never spoken line."), (1, 2, "Goodbye now.")], "file_id long, pos int, text string")
    out = tracks.align_transcript(segments, script).orderBy("pos").collect()
    assert [(r.source, r.text) for r in out] == [("script", "Hello there, friend."), ("transcript", "something else"), ("script", "Never spoken line."), ("script", "Goodbye now.")]
    s = tracks.alignment_summary(tracks.align_transcript(segments, script)).first()
    assert (s.total, s.from_script, s.no_audio) == (4, 3, 1)


def test_match_takes_overlap_alone_and_each_cue_once(spark):
    ours = spark.createDataFrame([(1, 1, 0, 1000, "abc"), (1, 2, 9000, 9500, "zzz")], CUE)
    truth = spark.createDataFrame([(1, 1, 500, 1500, "no common word"), (1, 2, 700, 1600, "abc")], CUE)
    got = {(r.our_idx, r.truth_idx) for r in tracks.match_to_reference_track(ours, truth).collect()}
    assert got == {(1, 1), (2, None), (None, 2)}


def test_translation_round_trip_keeps_source_without_a_reply(spark):
    def ask(lines: str) -> str:
        return "\n".join(x.upper() for x in lines.split("\n") if not x.startswith("2."))

    out, _ = jobs.translate_job(cue_table(spark, "one", "two", "three"), ask)
    assert {r.idx: (r.text, r.kept_source) for r in out.collect()} == {1: ("ONE", False), 2: ("two", True), 3: ("THREE", False)}


def test_revision_rounds_settle(spark):
    out, changed, why = jobs.revision_rounds(cue_table(spark, "aaaa  b", "c"), lambda d: d.withColumn("text", F.replace("text", F.lit("  "), F.lit(" "))))
    assert changed == [1, 0] and why == "settled" and {r.text for r in out.collect()} == {"aaaa b", "c"}


def test_flags_terms_and_overlap(spark):
    pairs = spark.createDataFrame([(1, 1, "[Sam] I do not know 5", "몰라요")], "file_id long, idx int, source string, target string")
    assert {r.kind for r in language.translation_flags(pairs).collect()} == {"speaker", "number"}
    back = spark.createDataFrame([(1, 1, "I can't find the red house", "find house")], "file_id long, idx int, source string, back string")
    r = language.back_translation_overlap(back).first()
    assert r.score == pytest.approx(0.5) and r.missing == "not,red"
    names = {x.term for x in language.proper_nouns(cue_table(spark, "We met Sarah. Nice day", "a nice Sarah's hat"), ["we"]).collect()}
    assert names == {"Sarah"}


def test_protect_and_restore(spark):
    df = spark.createDataFrame([("{\\an8}<i>She <b>never</b> left</i>",), ("♪ la la ♪",)], "t string").select(language.protect_markup(F.col("t")).alias("p"))
    rows = df.select("p.*", language.restore_markup(F.lit("X"), F.col("p")).alias("r")).collect()
    assert (rows[0].head, rows[0].body, rows[0].tail, rows[0].inner, rows[0].r) == ("{\\an8}<i>", "She never left", "</i>", True, "{\\an8}<i>X</i>")
    assert rows[1].r == "♪ X ♪"


def test_subtitle_files_round_trip(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\r\n00:00:01,5 --> 00:00:02,250\r\n<i>Hi</i>\r\nthere\r\n\r\n2\r\nno time\r\n\r\n7\r\n01:00:00.000 --> 01:00:01.000\r\n\r\n\r\n8\r\n00:01:00,000 --> 00:01:01,000\r\nend\r\n", encoding="utf-8")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nv\n\n00:03.000 --> 00:04.000\nshort form\n")
    (tmp_path / "a.fixed.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nskip\n")
    out = sorted((r.path.rpartition("/")[2], r.idx, r.start_ms, r.end_ms, r.text) for r in subtitles.read_subtitles(spark, str(tmp_path)).collect())
    assert out == [("a.srt", 1, 1500, 2250, "<i>Hi</i>\nthere"), ("a.srt", 2, 60000, 61000, "end"), ("b.vtt", 1, 1000, 2000, "v")]


def test_scripts_workbooks_and_stages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>SARAH: Hi</w:t></w:r></w:p><w:p><w:r><w:t/></w:r></w:p><w:p><w:r><w:t>(door)</w:t></w:r></w:p></w:document>')
    (tmp_path / "k.txt").write_bytes("민수: 안녕".encode("cp949"))
    rows = {(r.speaker, r.text) for r in subtitles.parse_script(subtitles.read_any(spark, str(tmp_path))).collect()}
    assert ("민수", "안녕") in rows and any(s == "Sarah" for s, _ in rows)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        cell = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{cell("A1", "notes")}</row><row>{cell("B2", "Source")}{cell("C2", "한국어")}</row><row>{cell("B3", "Sam")}{cell("C3", "샘")}</row><row>{cell("B4", "half")}</row></sheetData></worksheet>')
    (tmp_path / "g KNP.xlsx").write_bytes(buffer.getvalue())
    assert [(r.term, r.korean) for r in subtitles.read_workbook_terms(spark, str(tmp_path)).collect()] == [("Sam", "샘")]


def test_notes_and_sheets(spark):
    notes = spark.createDataFrame([(1, json.dumps({"bookmarks": [{"idx": 0, "txt": "a<br />b"}, {"idx": 1, "txt": " "}]}))], "file_id long, value string")
    assert [(r.idx, r.note, r.cue) for r in subtitles.parse_bookmarks(notes, cue_table(spark, "x", "y")).collect()] == [(1, "a\nb", "x")]


def test_lint_on_a_stream(spark, tmp_path):
    from sottovoce.streaming.lint import lint_stream

    cue_table(spark, "두 칸  여기", "하나").write.parquet(str(tmp_path / "in"))
    q = lint_stream(spark, str(tmp_path / "in"), profiles.FULL).writeStream.format("memory").queryName("linted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert "double_space" in {r.check for r in spark.table("linted").collect()}


def test_every_query_has_a_schema(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


def test_lexicon_and_infobox(spark):
    from sottovoce.operators import reference_data

    lexicon = spark.createDataFrame([("문", "[문이 닫힌다]"), ("문", "[닫히는 문짝]"), ("차", "[자동차 경적]")], "category string, term string")
    out = reference_data.effect_suggestions(spark.createDataFrame([("[자동차가 지나간다]",), ("[새]",)], "marker string"), lexicon).collect()
    assert [(r.marker, r.term) for r in out] == [("[자동차가 지나간다]", "[자동차 경적]")]
    assert reference_data._fields("x {{Infobox a|b=[[c|d]]|e={{f|g}} h|i=}} t") == {"b": "d", "e": "g h"}
    assert reference_data._fields(None) == {}
