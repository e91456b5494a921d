"""Fixes with exactly one answer, as text expressions applied in rule order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sottovoce.functions.text import trimmed
from sottovoce.operators.checks import ASIDES, COLON_LABEL, CURRENCY, marker_brackets

Fix = Callable[[Column, Mapping[str, Any]], Column]
FIXES: dict[str, Fix] = {}


def fix(f: Fix) -> Fix:
    FIXES[f.__name__] = f
    return f


def by_line(text: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), change), "\n")


def _section(p: Mapping[str, Any], a: str, b: str) -> Any:
    return (p.get(a) or {}).get(b)


@fix
def three_dot_ellipsis(text: Column, p: Mapping[str, Any]) -> Column:
    return F.regexp_replace(text, r"\.{3,}", "…")


@fix
def double_space(text: Column, p: Mapping[str, Any]) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


@fix
def italics_present(text: Column, p: Mapping[str, Any]) -> Column:
    return F.regexp_replace(text, r"(?i)</?i>|\{\\i[01]\}", "")


@fix
def line_end_period_or_comma(text: Column, p: Mapping[str, Any]) -> Column:
    def change(x: Column) -> Column:
        end = F.regexp_replace(x, r"(?U)\s+$", "")
        return F.when(end.rlike(r"[.,]$") & ~F.endswith(end, F.lit("...")), F.regexp_replace(end, r"(?U)\s*[.,]$", "")).otherwise(end)

    return by_line(text, change)


@fix
def acronym_with_periods(text: Column, p: Mapping[str, Any]) -> Column:
    """A letter with its period inside a run of two or more loses the period; no letter stands before the run."""
    # Mark whole runs first, then strip the periods between the marks.
    runs = F.split(F.regexp_replace(text, r"(?U)\b((?:[A-Za-z]\.){2,})", "\u0001$1\u0002"), "\u0001", -1)
    return F.array_join(F.transform(runs, lambda x: F.when(F.contains(x, F.lit("\u0002")), F.concat(F.replace(F.substring_index(x, "\u0002", 1), F.lit("."), F.lit("")), F.substring_index(x, "\u0002", -1))).otherwise(x)), "")


@fix
def music_note_spacing(text: Column, p: Mapping[str, Any]) -> Column:
    note = _section(p, "music", "music_note")
    if not note:
        return text
    return by_line(text, lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), rf"(?U)^{note}\s*", f"{note} "), rf"(?U)\s*{note}$", f" {note}"))


@fix
def dual_speaker_marker_format(text: Column, p: Mapping[str, Any]) -> Column:
    marker = _section(p, "dual_speaker", "marker")
    if not marker:
        return text
    return by_line(text, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)^-(?!-)\s*", "- " if marker.endswith(" ") else "-"))


@fix
def lyric_line_not_capitalized(text: Column, p: Mapping[str, Any]) -> Column:
    note = _section(p, "music", "music_note") or "♪"

    def change(x: Column) -> Column:
        s = trimmed(x)
        body = F.regexp_replace(s, rf"(?U)^{note}\s*", "")
        raised = F.concat(F.lit(f"{note} "), F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))
        return F.when(F.startswith(s, F.lit(note)) & body.rlike(r"^\p{Ll}"), raised).otherwise(s)

    return by_line(text, change)


@fix
def colon_speaker_prefix(text: Column, p: Mapping[str, Any]) -> Column:
    left, right = ((_section(p, "speaker_id", "enclosure") or "[]") + "[]")[:2]

    def change(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, COLON_LABEL, i)
        name = F.when(part(3).rlike("[A-Z]") & ~part(3).rlike("[a-z]"), F.initcap(part(3))).otherwise(part(3))
        rest = F.substring(x, F.length(part(0)) + 1, F.length(x))
        return F.when(x.rlike(COLON_LABEL), F.concat(part(1), part(2), F.lit(left), name, F.lit(f"{right} "), rest)).otherwise(x)

    return by_line(text, change)


@fix
def space_between_markers(text: Column, p: Mapping[str, Any]) -> Column:
    before, after = marker_brackets(p)
    return by_line(text, lambda x: F.when(trimmed(F.regexp_replace(x, ASIDES, "")) == "", x).otherwise(F.regexp_replace(x, rf"({before})[ \t]+(?={after})", "$1")))


#: Particles after a consonant and what they are after a vowel; only one-syllable ones can follow a match.
PARTICLES = {"을": "를", "은": "는", "이": "가", "과": "와"}


@fix
def currency_bul(text: Column, p: Mapping[str, Any]) -> Column:
    for old, new in PARTICLES.items():
        text = F.regexp_replace(text, rf"{CURRENCY}{old}", f" 달러{new}")
    return F.replace(F.regexp_replace(text, CURRENCY, " 달러"), F.lit("  달러"), F.lit(" 달러"))


@fix
def ellipsis_style_mismatch(text: Column, p: Mapping[str, Any]) -> Column:
    want = _section(p, "text", "ellipsis_char")
    if want == "…":
        return F.regexp_replace(text, r"\.{3,}", "…")
    return F.replace(text, F.lit("…"), F.lit("...")) if want == "..." else text


#: What is settled by a look at the other cues of the file, before texts are fixed.
BY_FILE = ["position_collides_with_forced_narrative"]


def _automatic(profile: Mapping[str, Any]) -> list[tuple[str, str]]:
    """(rule id, check) of the automatic rules, in their order."""
    return [(rule["id"], name) for rule in profile.get("rules") or [] if rule.get("auto") for name in (rule["check"] if isinstance(rule["check"], list) else [rule["check"]])]


def fix_names(profile: Mapping[str, Any]) -> tuple[list[str], list[str]]:
    """(fixers in rule order, labels of automatic rules without one); fixes of whole files are told by ``moves_positions``."""
    names, missing = [], []
    for rule, name in _automatic(profile):
        if name in BY_FILE:
            continue
        if name in FIXES:
            names += [name] * (name not in names)
        elif (label := f"{rule} ({name})") not in missing:
            missing.append(label)
    return names, missing


def moves_positions(profile: Mapping[str, Any]) -> bool:
    """Whether an automatic rule moves dialogue away from on-screen text."""
    return any(name in BY_FILE for _, name in _automatic(profile))


def fix_text(cues: DataFrame, profile: Mapping[str, Any], names: list[str] | None = None) -> DataFrame:
    """Cues with fixed text and the names of the fixes that changed it; times stay."""
    names = fix_names(profile)[0] if names is None else names
    out = cues.withColumn("f0", F.col("text"))
    for i, name in enumerate(names):
        # One column a step: each step is used twice, so it stays a column and is made once.
        out = out.withColumn(f"f{i + 1}", FIXES[name](F.col(f"f{i}"), profile))
    applied = F.filter(F.array(*[F.when(F.col(f"f{i}") != F.col(f"f{i + 1}"), n) for i, n in enumerate(names)]).cast("array<string>"), lambda x: x.isNotNull())
    return out.select(*[c for c in cues.columns if c != "text"], F.col(f"f{len(names)}").alias("text"), applied.alias("applied"))
