"""Checks of single cues as column expressions.

Each check maps a profile to an array of findings (line_no, detail), or to None where the profile does not ask
for it. All checks of a profile go into one projection over the cues, exploded once and joined with the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sottovoce.functions.text import BLANKS, SPEAKER_HEAD, excerpt, marked, one_decimal, particle, quoted, short_number, strip_tags, trimmed, weighted_chars

FOUND = "array<struct<line_no:int,detail:string>>"
Profile = Mapping[str, Any]
Check = Callable[[Profile], Column | None]
CHECKS: dict[str, Check] = {}


def check(f: Check) -> Check:
    CHECKS[f.__name__] = f
    return f


# Columns that the checks look at; functions, since a column needs a session.


def text_() -> Column:
    return F.col("text")


def plain_() -> Column:
    return F.col("plain")


def duration_() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def lines_() -> Column:
    return F.col("lines")


def bare_() -> Column:
    """Lines without markup."""
    return F.col("bare_lines")


def prepared(cues: DataFrame, p: Profile) -> DataFrame:
    """Adds what the checks look at: the text without markup, its words and weighted length, and lines with and without markup."""
    lines = cues.withColumn("plain", strip_tags(text_())).withColumn("lines", F.split("text", "\n", -1))
    words = F.size(F.filter(F.split("plain", r"(?U)\s+"), lambda w: w != ""))
    return lines.withColumn("bare_lines", F.transform("lines", strip_tags)).withColumn("chars", weighted_chars(text_(), *_weights(p))).withColumn("words", words)


def _section(p: Profile, *path: str) -> Any:
    for key in path:
        p = (p or {}).get(key)  # type: ignore[assignment]
    return p


def _weights(p: Profile) -> tuple[float, float]:
    w = _section(p, "limits", "char_weights") or {}
    return float(w.get("cjk", 1.0)), float(w.get("other", 1.0))


def none() -> Column:
    return F.array().cast(FOUND)


def has(*marks: str) -> Column:
    """Whether the text holds one of ``marks``; longer ones may also come together where markup is cut out."""
    found = reduce(or_, [F.contains(text_(), F.lit(m)) for m in marks])
    return found if all(len(m) == 1 for m in marks) else found | marked(text_())


def given(can: Column, found: Column) -> Column:
    """``found``, looked for only where a condition holds that is cheap and without which there is nothing."""
    return F.when(can, found).otherwise(none())


def cue(when: Column, detail: Column | str) -> Column:
    """One finding for the cue."""
    said = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.array(F.struct(F.lit(None).cast("int").alias("line_no"), said.alias("detail")))).otherwise(F.array()).cast(FOUND)


def each(lines: Column, when: Callable[[Column], Column], detail: Callable[[Column], Column] | str) -> Column:
    """One finding for each line that fires."""
    said = (lambda x: F.lit(detail)) if isinstance(detail, str) else detail
    pairs = F.transform(lines, lambda x, i: F.when(F.coalesce(when(x), F.lit(False)), F.struct((i + 1).cast("int").alias("line_no"), said(x).alias("detail"))))
    return F.filter(pairs, lambda x: x.isNotNull()).cast(FOUND)


def hits(text: Column, marks: list[str]) -> Column:
    """Those of ``marks`` that ``text`` contains, in their order."""
    return F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def count_of(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def mark_found(text: Column, marks: list[str], sep: str = ", ") -> Column:
    return cue(reduce(or_, [F.contains(text, F.lit(m)) for m in marks]), F.array_join(hits(text, marks), sep))


# Numbers


@check
def duration_out_of_range(p: Profile) -> Column | None:
    low, high = _section(p, "limits", "duration_ms", "min"), _section(p, "limits", "duration_ms", "max")
    under = duration_() < F.lit(low) if low is not None else F.lit(False)
    over = duration_() > F.lit(high) if high is not None else F.lit(False)
    return cue(under | over, F.when(under, F.concat(duration_(), F.lit(f"ms — 최소 {low}ms"))).otherwise(F.concat(duration_(), F.lit(f"ms — 최대 {high}ms"))))


@check
def too_many_lines(p: Profile) -> Column | None:
    if limit := _section(p, "limits", "max_lines"):
        return cue(F.size(lines_()) > limit, F.concat(F.size(lines_()), F.lit(f"줄 — 최대 {limit}줄")))


@check
def line_length_exceeded(p: Profile) -> Column | None:
    if limit := _section(p, "limits", "chars_per_line"):
        sizes = F.transform(lines_(), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), weighted_chars(x, *_weights(p)).alias("size")))
        return F.transform(F.filter(sizes, lambda s: s["size"] > limit), lambda s: F.struct(s["line_no"].alias("line_no"), F.concat(short_number(s["size"]), F.lit(f"자 — 최대 {limit}자")).alias("detail"))).cast(FOUND)


def _speed(p: Profile) -> Column:
    return F.when(duration_() <= 0, F.lit(float("inf"))).otherwise(F.col("chars") / (duration_() / 1000.0))


@check
def reading_speed_exceeded(p: Profile) -> Column | None:
    if limit := _section(p, "limits", "reading_speed_cps", "children" if p.get("children") else "adult"):
        return cue(_speed(p) > limit, F.concat(one_decimal(_speed(p)), F.lit(f" CPS — 최대 {limit} CPS")))


@check
def optimal_cps_exceeded(p: Profile) -> Column | None:
    if limit := _section(p, "limits", "optimal_cps"):
        hard = _section(p, "limits", "reading_speed_cps", "children" if p.get("children") else "adult")
        within = _speed(p) <= hard if hard else F.lit(True)
        return cue((_speed(p) > limit) & within, F.concat(one_decimal(_speed(p)), F.lit(f" CPS — 권장 {limit} CPS")))


@check
def words_per_minute_exceeded(p: Profile) -> Column | None:
    if limit := _section(p, "limits", "words_per_minute"):
        rate = F.when(duration_() > 0, F.col("words") / (duration_() / 60000.0))
        return cue(F.coalesce(rate > limit, F.lit(False)), F.concat(F.bround(rate).cast("long"), F.lit(f" 어절/분 — 최대 {limit}")))


@check
def too_short_to_stand_alone(p: Profile) -> Column | None:
    if limit := _section(p, "limits", "merge_shorter_than_ms"):
        return cue(duration_() < limit, F.concat(duration_(), F.lit(f"ms — {limit}ms 미만은 병합을 검토합니다")))


# Line breaks

#: Words that lean on the word before them, helping verbs, words that lead a noun, endings that do.
DEPENDENT = ["것", "거", "수", "줄", "리", "바", "터, ", "테", "때", "적", "만큼", "뿐", "듯", "채", "체", "척", "김", "탓", "덕분", "대로", "따름", "나름", "무렵", "즈음", "동안", "사이", "가운데", "중", "편", "지", "번", "개", "명", "마리", "권", "장"]
HELPING = ["하다", "하고", "해서", "해도", "한다", "합니다", "했다", "있다", "있는", "있어", "없다", "보다", "보고", "봐", "주다", "주고", "줘", "드리다", "드려", "버리다", "버렸", "가다", "오다", "지다", "싶다", "싶어", "말다", "놓다", "두다"]
LEADING = ["그", "이", "저", "어느", "무슨", "웬", "한", "두", "세", "네", "온", "각", "여러", "모든", "새", "옛"]
ADNOMINAL = r"(던|된|다는|라는|하는|되는|있는|없는|시킨|당한)$"


def _two_lines(p: Profile) -> tuple[Column, Column, Column]:
    upper, lower = F.get(bare_(), 0), F.get(bare_(), 1)
    return upper, lower, F.lit(p.get("language") == "ko") & (F.size(lines_()) == 2) & ~lower.rlike(r"(?U)^\s*-")


@check
def line_break_position(p: Profile) -> Column | None:
    upper, lower, two = _two_lines(p)
    said = lambda before, word, after: F.concat(F.lit(f"{before}'"), word, F.lit("'"), particle(word, "으로", "로"), F.lit(after))
    starts = lambda head, words: reduce(or_, [F.startswith(head, F.lit(w)) for w in words])

    def told(w: Column) -> Column:
        head, tail = w["head"], w["tail"]
        noun = (w["leads"] | w["modifies"]) & starts(head, DEPENDENT)
        first = F.when(noun, said("아랫줄이 의존명사 ", head, " 시작합니다 — 앞말과 붙는 말입니다")).when(starts(head, HELPING), said("아랫줄이 보조 용언 ", head, " 시작합니다 — 본용언과 갈렸습니다"))
        led = said("윗줄이 관형사 ", tail, " 끝납니다 — 꾸밈받는 말과 갈렸습니다")
        second = F.when(w["leads"], led).when(w["modifies"] & (F.length(tail) > 1) & ~noun & ~starts(head, HELPING), said("윗줄이 ", tail, " 끝나 꾸밈받는 말과 갈렸을 수 있습니다"))
        return F.filter(F.array(first, second), lambda x: x.isNotNull())

    # The last word of the upper line lies at its end, so nothing before its last blank is looked at.
    words = F.struct(F.regexp_extract(lower, r"(?U)^\s*(\S+)", 1).alias("head"), F.regexp_extract(trimmed(upper), r"(?U)(?<!\S)(\S+)$", 1).alias("tail"))
    bound = F.transform(F.array(words), lambda w: F.struct(w["head"].alias("head"), w["tail"].alias("tail"), w["tail"].isin(LEADING).alias("leads"), w["tail"].rlike(ADNOMINAL).alias("modifies")))
    found = F.flatten(F.transform(bound, told))
    both = two & (trimmed(upper) != "") & (trimmed(lower) != "")
    return given(both, F.transform(found, lambda d: F.struct(F.lit(2).alias("line_no"), d.alias("detail"))).cast(FOUND))


@check
def line_break_top_heavy(p: Profile) -> Column | None:
    _, _, two = _two_lines(p)
    upper, lower = (weighted_chars(F.get(lines_(), i), *_weights(p)) for i in (0, 1))
    said = F.concat(F.lit("윗줄("), short_number(upper), F.lit("자)이 아랫줄("), short_number(lower), F.lit("자)의 2배 이상입니다 — 다른 자리에서 끊을 수 있는지 보세요"))
    return F.when(F.coalesce(two & (lower > 0) & (upper >= lower * 2), F.lit(False)), F.array(F.struct(F.lit(2).alias("line_no"), said.alias("detail")))).otherwise(F.array()).cast(FOUND)


# Punctuation and notation


@check
def line_end_period_or_comma(p: Profile) -> Column | None:
    end = lambda x: F.rtrim(x, F.lit(BLANKS))
    return given(has(".", ","), each(bare_(), lambda x: (F.endswith(end(x), F.lit(".")) | F.endswith(end(x), F.lit(","))) & ~F.endswith(end(x), F.lit("...")), lambda x: F.concat(F.lit("…"), quoted(F.right(end(x), F.lit(12))))))


@check
def three_dot_ellipsis(p: Profile) -> Column | None:
    return cue(F.contains(text_(), F.lit("...")), "'...' 발견")


@check
def em_or_en_dash(p: Profile) -> Column | None:
    marks = ["–", "—"]
    return cue(has(*marks), F.concat(F.array_join(hits(text_(), marks), " "), F.lit(" 발견")))


@check
def double_space(p: Profile) -> Column | None:
    return given(has("  "), each(bare_(), lambda x: F.contains(x, F.lit("  ")), "이중 공백"))


@check
def italics_present(p: Profile) -> Column | None:
    return given(has("<", "{"), cue(text_().rlike(r"(?i)<i>|</i>|\{\\i1\}"), "이탤릭 태그"))


@check
def acronym_with_periods(p: Profile) -> Column | None:
    pattern = r"(?U)\b(?:[A-Za-z]\.){2,}"
    return given(has("."), cue(text_().rlike(pattern), F.regexp_extract(text_(), pattern, 0)))


@check
def dual_speaker_marker_format(p: Profile) -> Column | None:
    if marker := _section(p, "dual_speaker", "marker"):
        blank = marker.endswith(" ")
        return given(has("-"), each(bare_(), lambda x: x.rlike(r"(?U)^\s*-[^ -]|^\s*-$" if blank else r"(?U)^\s*- "), "하이픈 뒤 공백이 없습니다" if blank else "하이픈 뒤 공백이 있습니다"))


@check
def bracket_unclosed(p: Profile) -> Column | None:
    n, m = count_of(plain_(), "["), count_of(plain_(), "]")
    return given(has("[", "]"), cue(n != m, F.format_string("'[' %d개 / ']' %d개", n.cast("int"), m.cast("int"))))


@check
def forbidden_foreign_marker(p: Profile) -> Column | None:
    if marks := _section(p, "foreign_dialogue", "forbidden_markers"):
        return mark_found(text_(), marks)


@check
def discouraged_sound_ending(p: Profile) -> Column | None:
    if endings := _section(p, "sound_effect", "discouraged_endings"):
        inner = F.regexp_extract_all(plain_(), F.lit(r"\[([^\]]*)\]"), F.lit(1))
        bad = F.filter(inner, lambda x: F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(F.regexp_replace(trimmed(x), r"\.+$", ""), e)))
        return given(has("["), F.transform(bad, lambda x: F.struct(F.lit(None).cast("int").alias("line_no"), F.concat(F.lit("["), x, F.lit("]")).alias("detail"))).cast(FOUND))


@check
def stutter_label(p: Profile) -> Column | None:
    if marks := _section(p, "sound_effect", "discouraged_labels"):
        return mark_found(text_(), marks)


@check
def discouraged_silence_expression(p: Profile) -> Column | None:
    if marks := _section(p, "sound_effect", "discouraged_expressions"):
        return mark_found(text_(), marks)


# Music


def _note(p: Profile) -> str:
    return _section(p, "music", "music_note") or "♪"


@check
def music_note_spacing(p: Profile) -> Column | None:
    note = _section(p, "music", "music_note")
    if not note or not _section(p, "music", "space_between_note_and_text"):
        return None
    opening = each(bare_(), lambda x: F.startswith(trimmed(x), F.lit(note)) & (F.length(trimmed(x)) > 1) & (F.substring(trimmed(x), 2, 1) != " "), "여는 음표 뒤 공백 없음")
    closing = each(bare_(), lambda x: F.endswith(trimmed(x), F.lit(note)) & (F.length(trimmed(x)) > 1) & (F.left(F.right(trimmed(x), F.lit(2)), F.lit(1)) != " "), "닫는 음표 앞 공백 없음")
    return given(has(note), F.concat(opening, closing))


@check
def music_note_unpaired(p: Profile) -> Column | None:
    if note := _section(p, "music", "music_note"):
        return given(has(note), each(bare_(), lambda x: count_of(x, note) % 2 != 0, lambda x: F.concat(F.lit("음표 "), count_of(x, note).cast("int"), F.lit("개 — 줄 앞뒤로 짝을 맞춥니다"))))


@check
def lyric_line_not_capitalized(p: Profile) -> Column | None:
    if _section(p, "music", "capitalize_line_start"):
        body = lambda x: trimmed(F.ltrim(trimmed(x), F.lit(_note(p))))
        return given(has(_note(p)), each(bare_(), lambda x: F.startswith(trimmed(x), F.lit(_note(p))) & body(x).rlike(r"^\p{Ll}"), lambda x: quoted(F.substring(body(x), 1, 20))))


@check
def lyrics_punctuation(p: Profile) -> Column | None:
    if marks := _section(p, "songs", "forbidden_punctuation"):
        found = lambda x: hits(trimmed(x), list(marks))
        return given(has(_note(p)), each(bare_(), lambda x: F.contains(x, F.lit(_note(p))) & (F.size(found(x)) > 0), lambda x: F.concat(F.lit("가사에 "), F.array_join(found(x), " "), F.lit(" — 쓰지 않습니다"))))


@check
def lyrics_with_dialogue(p: Profile) -> Column | None:
    if _section(p, "songs", "lyrics_with_dialogue_in_one_event") == "forbidden":
        note = F.lit(_note(p))
        lines = F.filter(F.transform(bare_(), trimmed), lambda x: x != "")
        spoken = F.exists(lines, lambda x: ~F.contains(x, note) & ~x.rlike(r"^-?\s*[\[(][^\])]*[\])]$"))
        return given(has(_note(p)), cue(F.exists(lines, lambda x: F.contains(x, note)) & spoken, "가사와 대사를 한 자막에 넣지 않습니다 — 자막을 나눕니다"))


@check
def music_marker_style(p: Profile) -> Column | None:
    want = _section(p, "music", "note_inside_bracket")
    if want is None:
        return None
    inner = F.regexp_extract_all(plain_(), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    bad = F.filter(inner, lambda x: x.rlike("음악|곡|연주|노래") & (~F.contains(x, F.lit("♪")) if want else F.contains(x, F.lit("♪"))))
    said = "] — 음악 효과음에는 ♪를 넣습니다" if want else "] — 음악 효과음에 ♪를 넣지 않습니다"
    return given(has("["), F.transform(bad, lambda x: F.struct(F.lit(None).cast("int").alias("line_no"), F.concat(F.lit("["), x, F.lit(said)).alias("detail"))).cast(FOUND))


# Numbers and names in words

#: Patterns for money, clock times, numerals, labels and ranges, and symbols with the words for them.
CURRENCY = r"(?<=[\d만천억조])\s*불(?=짜리|[을를은는이가에의와과도만]?(?:\s|$|[,.!?…]))"
CLOCK = r"(?<![가-힣])(한|두|세|네|다섯|여섯|일곱|여덟|아홉|열한|열두|열)\s*시(?=[에는을를쯤경까부터'\s,.!?…]|$)"
TEN_PLUS = r"(?<![가-힣])(?:열|스물|서른|마흔|쉰|예순|일흔|여든|아흔)(?:하나|한|둘|두|셋|세|넷|네|다섯|여섯|일곱|여덟|아홉)?\s*(개|명|번|살|가지|마리|대|권|장|병|잔|켤레|자루|시간|분|초|년|달|주)"
COLON_LABEL = r"^(\s*)(-\s*)?((?:[A-Z][A-Za-z.'\-]*)(?:\s+[A-Z][A-Za-z.'\-]*){0,2}|[가-힣][가-힣0-9]{0,7})\s*:\s+(?=[^\d])"
HONORIFIC = r"(?<![가-힣])([가-힣]{1,4})\s*씨(?![가-힣])"
NOT_A_NAME = ["한", "그", "이", "저", "무슨", "어느", "옆", "같은"]
SYMBOLS = {"㎡": "제곱미터", "㎢": "제곱킬로미터", "㎝": "센티미터", "㎞": "킬로미터", "㎏": "킬로그램", "℃": "도", "℉": "화씨", "㎖": "밀리리터", "ℓ": "리터", "²": "제곱", "³": "세제곱", "±": "플러스마이너스", "×": "곱하기", "÷": "나누기", "&": "그리고", "＃": "샵"}
UNITS = "㎡㎥㎢㎠㎣㎝㎜㎞㎏㎎㎖㎗㎘℃℉㎈㎉㎐㎑㎒㎓㎧㎨㏄㏊㎀㎁㎂㎃㎄"
RANGE_SPACED = r"(?:\d|[만천억백])\s+[~\-–—]\s*\d|\d\s*[~\-–—]\s+\d"
RANGE_UNIT = r"(?<![\d,])(\d+)\s*[~\-–—]\s*(\d+)\s*(만|천|억|백)"
ADVERB_COMMA = r"^(그러나|또한|사실|하지만|그런데|그리고|따라서|그래서|즉|물론),"
ASIDES = r"[\[(][^)\]]*[\])]|\{[^}]*\}"


@check
def currency_bul(p: Profile) -> Column | None:
    return given(has("불"), each(bare_(), lambda x: x.rlike(CURRENCY), "'불' -> '달러'"))


@check
def special_symbol(p: Profile) -> Column | None:
    found = lambda x: F.transform(F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in SYMBOLS.items()]), lambda m: F.contains(x, m["s"])), lambda m: F.concat(m["s"], F.lit(" -> "), m["w"]))
    return given(has(*SYMBOLS), each(bare_(), lambda x: F.size(found(x)) > 0, lambda x: F.array_join(F.slice(found(x), 1, 3), ", ")))


@check
def hangul_clock(p: Profile) -> Column | None:
    return given(has("시"), each(bare_(), lambda x: x.rlike(CLOCK), lambda x: F.concat(F.lit("'"), F.regexp_extract(x, CLOCK, 0), F.lit("' — 시각은 아라비아 숫자로"))))


@check
def hangul_number_ten_plus(p: Profile) -> Column | None:
    return given(has("열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔"), each(bare_(), lambda x: x.rlike(TEN_PLUS), lambda x: F.concat(F.lit("'"), F.regexp_extract(x, TEN_PLUS, 0), F.lit("' — 10 이상은 아라비아 숫자로"))))


@check
def colon_speaker_prefix(p: Profile) -> Column | None:
    return given(has(":"), each(bare_(), lambda x: x.rlike(COLON_LABEL), lambda x: F.concat(F.lit("'"), F.regexp_extract(x, COLON_LABEL, 3), F.lit(":' — 대본 표기가 그대로 남았습니다"))))


@check
def honorific_ssi_used(p: Profile) -> Column | None:
    if not _section(p, "address", "forbid_ssi"):
        return None
    part = lambda x, k: F.regexp_extract_all(F.regexp_replace(x, ASIDES, " "), F.lit(HONORIFIC), F.lit(k))
    names = lambda x: F.filter(F.arrays_zip(part(x, 0).alias("all"), part(x, 1).alias("name")), lambda n: ~n["name"].isin(NOT_A_NAME))
    found = F.flatten(F.transform(bare_(), lambda x, i: F.transform(names(x), lambda n: F.struct((i + 1).cast("int").alias("line_no"), F.concat(F.lit("'"), trimmed(n["all"]), F.lit("' — 다큐·리얼리티에서는 쓰지 않습니다")).alias("detail")))))
    return given(has("씨"), found.cast(FOUND))


@check
def forbidden_punctuation(p: Profile) -> Column | None:
    marks = _section(p, "text", "forbidden_punctuation")
    if not marks:
        return None
    body = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\[(][^)\]]*[\])]", " "), r"(?<=\d):(?=\d)", " ")
    found = F.flatten(F.transform(bare_(), lambda x, i: F.transform(hits(body(x), marks), lambda m: F.struct((i + 1).cast("int").alias("line_no"), F.concat(F.lit("'"), m, F.lit("' 발견")).alias("detail")))))
    return given(has(*marks) | F.lit(any(not m.strip() or len(m) > 1 for m in marks)), found.cast(FOUND))


def marker_brackets(p: Profile) -> tuple[str, str]:
    """Patterns of what ends and what begins a mark, with the brackets that the profile uses."""
    pairs = {_section(p, "speaker_id", "enclosure") or "[]", _section(p, "tone", "enclosure") or _section(p, "sound_effect", "enclosure") or "[]", "[]", "()"}
    either = lambda at: "".join(sorted({rf"\{x[at]}" for x in pairs}))
    return rf"[{either(-1)}]|\}}", f"[{either(0)}]"


@check
def space_between_markers(p: Profile) -> Column | None:
    before, after = marker_brackets(p)
    gap = rf"(?:{before})[ \t]+{after}"
    return given(text_().rlike(after), each(bare_(), lambda x: x.rlike(gap) & (trimmed(F.regexp_replace(x, ASIDES, "")) != ""), "표시끼리는 붙여 씁니다"))


@check
def dialogue_double_quote(p: Profile) -> Column | None:
    return given(has('"', "“", "”"), each(bare_(), lambda x: x.rlike('["“”]'), "말자막이면 큰따옴표를 쓰지 않습니다"))


@check
def unit_composed_character(p: Profile) -> Column | None:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text_(), F.lit(f"([{UNITS}])"), F.lit(1))))
    return given(text_().rlike(rf"[\u2100-\uFFFF&&[{UNITS}]]"), cue(F.size(found) > 0, F.concat(F.array_join(found, " "), F.lit(" — 조합 문자 대신 풀어 씁니다"))))


@check
def ampersand_outside_initialism(p: Profile) -> Column | None:
    return given(has("&"), cue(plain_().rlike(r"(?<!\p{Lu})&|&(?!\p{Lu})"), "'&'는 및·겸·쉼표로 바꿉니다"))


@check
def middle_initial_period(p: Profile) -> Column | None:
    pattern = r"(?U)(?<![A-Za-z])[A-Z]\.(?=\s)"
    return given(has("."), cue(plain_().rlike(pattern), F.concat(F.regexp_extract(plain_(), pattern, 0), F.lit(" — 가운데 이름 뒤 온점을 뗍니다"))))


@check
def effect_after_dialogue(p: Profile) -> Column | None:
    before = lambda x: trimmed(F.regexp_extract(trimmed(x), r"(?s)^(.*?)\[[^\]]+\]\s*$", 1))
    return given(has("["), each(bare_(), lambda x: (before(x) != "") & ~before(x).rlike(r"^[-\s]*[\[(][^\])]*[\])]$"), lambda x: F.concat(F.lit("대사 뒤 효과음 "), F.regexp_extract(trimmed(x), r"(\[[^\]]+\])\s*$", 1))))


@check
def ellipsis_style_mismatch(p: Profile) -> Column | None:
    want = _section(p, "text", "ellipsis_char")
    if want == "…":
        return cue(F.contains(plain_(), F.lit("...")), "'...' -> '…'")
    if want == "...":
        return cue(F.contains(plain_(), F.lit("…")), "'…' -> '...'")
    return None


@check
def double_punctuation(p: Profile) -> Column | None:
    if _section(p, "text", "double_punctuation") in ("forbidden", "limited"):
        return given(has("?", "!"), cue(plain_().rlike("[?!]{2,}"), F.regexp_extract(plain_(), "[?!]{2,}", 0)))


@check
def tilde_used(p: Profile) -> Column | None:
    if _section(p, "text", "tilde") == "forbidden":
        return cue(F.contains(plain_(), F.lit("~")), "'~'")


@check
def sound_effect_multiline(p: Profile) -> Column | None:
    return given(has("[", "]"), F.slice(each(bare_(), lambda x: count_of(x, "[") != count_of(x, "]"), "효과음 표기가 줄을 넘어갑니다 — 한 줄로 씁니다"), 1, 1))


@check
def bleep_mask_character(p: Profile) -> Column | None:
    mask = _section(p, "censorship", "bleeped_word")
    if mask == "*":
        return given(has("O"), cue(plain_().rlike("O+(?=[가-힣])|(?<=[가-힣])O+"), "삐 처리는 별표(*)로 합니다"))
    if mask == "O":
        return given(has("*"), cue(plain_().rlike(r"\*+(?=[가-힣])|(?<=[가-힣])\*+"), "삐 처리는 대문자 O로 합니다"))
    return None


@check
def full_bleep_style(p: Profile) -> Column | None:
    style = _section(p, "censorship", "full_sentence_bleep")
    if not style:
        return None
    if style == "[음 소거 효과음]":
        return given(has("*", "O"), cue(plain_().rlike(r"[*O]{2,}(\s+[*O]{2,})+"), "여러 단어가 삐 처리되면 [음 소거 효과음]으로 씁니다"))
    return cue(F.contains(plain_(), F.lit("음 소거")), "여러 단어가 삐 처리되면 부호를 늘어놓습니다([음 소거 효과음] 아님)")


# Speakers

HEAD = r"^\s*-?\s*([\[(])([^\])]+)([\])])\s*(.*)$"


def _headed(x: Column) -> Column:
    return trimmed(F.regexp_extract(x, HEAD, 4)) != ""


@check
def speaker_id_enclosure(p: Profile) -> Column | None:
    want = _section(p, "speaker_id", "enclosure")
    if want not in ("[]", "()"):
        return None
    used = lambda x: F.concat(F.regexp_extract(x, HEAD, 1), F.regexp_extract(x, HEAD, 3))
    return given(has("[", "("), each(bare_(), lambda x: _headed(x) & (used(x) != want), lambda x: F.concat(used(x), F.lit(f" -> {want} 로 씁니다"))))


@check
def speaker_id_conjunction(p: Profile) -> Column | None:
    inner = lambda x: F.regexp_extract(x, HEAD, 2)
    return given(has("[", "("), each(bare_(), lambda x: _headed(x) & inner(x).rlike(r"[가-힣]{1,6}(와|과)\s+[가-힣]"), lambda x: F.concat(F.lit("["), inner(x), F.lit("] — 쉼표로 나열하거나 [함께]로 씁니다"))))


@check
def speaker_id_alone_on_line(p: Profile) -> Column | None:
    lines = F.transform(bare_(), trimmed)
    following = lambda i: F.get(lines, i + 1)
    pairs = F.transform(lines, lambda x, i: F.when(F.coalesce(x.rlike(r"^-?\s*[\[(][^\])]+[\])]$") & (following(i) != "") & ~following(i).rlike(r"^[\[(\-♪]"), F.lit(False)), F.struct((i + 1).cast("int").alias("line_no"), F.concat(x, F.lit(" — 대사 첫마디와 같은 줄에 둡니다")).alias("detail"))))
    return given(has("[", "("), F.filter(pairs, lambda x: x.isNotNull()).cast(FOUND))


@check
def translator_credit_present(p: Profile) -> Column | None:
    if _section(p, "credit", "translator_credit") == "forbidden":
        return cue(plain_().rlike(r"자막\s*[:：]"), "이 플랫폼은 자막 제작자 크레딧을 넣지 않습니다")


@check
def range_notation(p: Profile) -> Column | None:
    if not _section(p, "numbers", "range_notation_strict"):
        return None
    part = lambda i: F.regexp_extract(plain_(), RANGE_UNIT, i)
    spaced = cue(plain_().rlike(RANGE_SPACED), F.concat(trimmed(F.regexp_extract(plain_(), RANGE_SPACED, 0)), F.lit(" — 범위 부호 앞뒤를 띄우지 않습니다")))
    unit = cue(plain_().rlike(RANGE_UNIT), F.concat(part(0), F.lit(" — 앞쪽 수에도 단위를 붙입니다("), part(1), part(3), F.lit("~"), part(2), part(3), F.lit(")")))
    return given(has("~", "-", "–", "—"), F.concat(spaced, unit))


@check
def conjunctive_adverb_comma(p: Profile) -> Column | None:
    if _section(p, "text", "no_comma_after_conjunctive_adverb"):
        return given(has(","), each(bare_(), lambda x: trimmed(x).rlike(ADVERB_COMMA), lambda x: F.concat(F.regexp_extract(trimmed(x), ADVERB_COMMA, 1), F.lit(", — 접속부사 뒤에는 쉼표를 쓰지 않습니다"))))


@check
def ellipsis_leading(p: Profile) -> Column | None:
    lead = r"^-?\s*(…|\.\.\.)"
    return given(has("…", "..."), each(bare_(), lambda x: ~F.contains(x, F.lit("♪")) & trimmed(x).rlike(lead), lambda x: F.concat(F.regexp_extract(trimmed(x), lead, 1), F.lit(" — 앞을 줄이는 말줄임표(전략)는 쓰지 않습니다"))))


def findings(cues: DataFrame, profile: Profile, names: list[str] | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, idx, check, line_no, detail) of all cue checks that the profile asks for, from one scan; with the columns ``kept`` of the cue."""
    asked = {n: c for n in names or CHECKS if (c := CHECKS[n](profile)) is not None}

    def named(name: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(name).alias("check"), x["line_no"].alias("line_no"), x["detail"].alias("detail"))

    # A check that comes to nothing, as on a missing text, leaves the findings of the others.
    tagged = [F.coalesce(F.transform(c, named(n)), F.array().cast("array<struct<check:string,line_no:int,detail:string>>")) for n, c in asked.items()]
    each_one = prepared(cues, profile).select("file_id", "idx", *kept, F.explode(F.concat(*tagged)).alias("f"))
    return each_one.select("file_id", "idx", *kept, "f.check", "f.line_no", "f.detail")


def counted(cues: DataFrame, profile: Profile, names: list[str] | None = None) -> DataFrame:
    """(file_id, idx, n): how many findings each cue has, without a row for each of them."""
    asked = [c for n in names or CHECKS if (c := CHECKS[n](profile)) is not None]
    each_one = F.array(*[F.coalesce(F.size(F.coalesce(c, none())), F.lit(0)) for c in asked])
    return prepared(cues, profile).select("file_id", "idx", F.aggregate(each_one, F.lit(0), lambda a, n: a + n).alias("n"))


def report(cues: DataFrame, found: DataFrame, rules: DataFrame, limits: Mapping[str, Any]) -> DataFrame:
    """Findings with their rules: id, clause, message with the limits filled in, and an excerpt. Rules are few and broadcast;
    findings that have kept the ``text`` need no look at the cues."""
    message = F.col("message")
    for key, value in limits.items():
        message = F.replace(message, F.lit(f"{{{key}}}"), F.lit(str(value)))
    joined = found.join(F.broadcast(rules.select("rule_id", "clause", "check", "auto", "message", "pos")), "check")
    if "text" not in found.columns:
        joined = joined.join(cues.select("file_id", "idx", "text"), ["file_id", "idx"])
    return joined.select("file_id", "idx", "rule_id", "clause", "check", "line_no", "detail", "auto", message.alias("message"), excerpt(F.col("text"), F.col("line_no")).alias("excerpt"))


def unimplemented(rules: DataFrame, implemented: list[str]) -> DataFrame:
    """Declared checks without an implementation, as ``ID (name)``; never counted as passed."""
    return rules.filter(~F.col("check").isin(implemented)).select(F.concat("rule_id", F.lit(" ("), "check", F.lit(")")).alias("label")).distinct()
