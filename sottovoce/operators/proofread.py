"""Proofreading of the dialogue between the marks of a cue: chunks by slot, a caller's corrector, findings, and the text put back."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sottovoce.functions.text import quoted, trimmed

#: What a corrector never sees, and what its findings are called.
MARKUP = r"\[[^\]]*\]|♪|\{\\[^}]*\}|<[^>]+>"
LEADING_DASH = r"^\s*-\s*"
CLAUSE = "한글 맞춤법 · 표준어 규정"
SUGGESTED, FLAGGED = "한국어 교정 제안", "한국어 확인 필요"

#: Takes the dialogue of one file and returns the corrected texts, as many, and flags with line_index (from 1), reason, suggested_fix, original_text.
Corrector = Callable[[list[str]], tuple[list[str], list[dict[str, Any]]]]


def split_markup(line: Column) -> Column:
    """ARRAY<STRUCT<markup, text>> of a line: its marks and the text between them, in order, none of them empty."""
    dash = F.regexp_extract(line, f"(?U)({LEADING_DASH})", 1)
    rest = F.substring(line, F.length(dash) + 1, F.length(line))
    between, marks = F.split(rest, MARKUP, -1), F.regexp_extract_all(rest, F.lit(f"({MARKUP})"), F.lit(1))
    chunk = lambda markup, text: F.struct(F.lit(markup).alias("markup"), text.alias("text"))
    pairs = F.transform(between, lambda t, i: F.array(chunk(False, t), chunk(True, F.coalesce(F.get(marks, i), F.lit("")))))
    return F.filter(F.concat(F.array(chunk(True, dash)), F.flatten(pairs)), lambda c: c["text"] != "")


def chunks(cues: DataFrame) -> DataFrame:
    """(file_id, idx, line_no, chunk_no, markup, text) of all cues; lines count from 1, chunks from 0."""
    lines = cues.select("file_id", "idx", F.posexplode(F.split("text", "\n", -1)).alias("l", "line"))
    return lines.select("file_id", "idx", (F.col("l") + 1).alias("line_no"), F.posexplode(split_markup(F.col("line"))).alias("chunk_no", "c")).select("file_id", "idx", "line_no", "chunk_no", "c.*")


def dialogue_only(cues: DataFrame) -> DataFrame:
    return chunks(cues).filter(~F.col("markup") & (trimmed(F.col("text")) != "")).drop("markup")


def rebuild(cues: DataFrame, corrected: DataFrame) -> DataFrame:
    """The cues with the texts of (file_id, idx, line_no, chunk_no, after) in their slots; other columns stay."""
    said = corrected.groupBy("file_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "line_no", "chunk_no"), "after"))).alias("said"))
    joined = cues.join(said, ["file_id", "idx"], "left")
    slot = lambda l, c: F.concat_ws(":", (l + 1).cast("string"), c.cast("string"))
    line = lambda x, l: F.array_join(F.transform(split_markup(x), lambda c, i: F.coalesce(F.element_at("said", slot(l, i)), c["text"])), "")
    text = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    return joined.select(*[text.alias("text") if c == "text" else c for c in cues.columns])


ANSWERED = "array<struct<after: string, flags: array<struct<reason: string, suggested_fix: string, original_text: string>>>>"


def corrected(cues: DataFrame, correct: Corrector) -> DataFrame:
    """Each dialogue chunk with what the corrector made of it and its flags; a corrector sees the dialogue of one file.

    Another number of texts than was given stops the job. Flags that point beyond the texts are left out.
    """
    keys = ("reason", "suggested_fix", "original_text")

    @F.pandas_udf(ANSWERED)
    def ask(file_ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for file_id, before in zip(file_ids, texts, strict=True):
            after, flags = correct(list(before))
            if len(after) != len(before):
                raise ValueError(f"file {file_id}: the corrector returned {len(after)} texts for {len(before)}")
            by_line: dict[int, list[dict[str, Any]]] = {}
            for f in flags:
                by_line.setdefault(f["line_index"], []).append({k: f.get(k) for k in keys})
            out.append([{"after": t, "flags": by_line.get(i, [])} for i, t in enumerate(after, 1)])
        return pd.Series(out, dtype="object")

    # One row a file, so that a batch holds many files; a data frame for each would cost more than the corrector.
    slots = F.array_sort(F.collect_list(F.struct("idx", "line_no", "chunk_no", F.col("text").alias("before"))))
    files = dialogue_only(cues).groupBy("file_id").agg(slots.alias("slots"))
    answered = files.select("file_id", "slots", ask("file_id", "slots.before").alias("said"))
    return answered.select("file_id", F.explode(F.arrays_zip("slots", "said")).alias("x")).select(F.col("file_id").cast("long").alias("file_id"), "x.slots.*", "x.said.*")


def proofread_findings(answered: DataFrame) -> DataFrame:
    """K01 for each changed chunk, K02 for each flag: (file_id, idx, line_no, rule_id, clause, message, detail, auto, excerpt)."""
    said = lambda rule, message, detail, auto, text: F.struct(F.lit(rule).alias("rule_id"), F.lit(CLAUSE).alias("clause"), F.lit(message).alias("message"), detail.alias("detail"), F.lit(auto).alias("auto"), trimmed(text).alias("excerpt"))
    changed = F.when(F.col("before") != F.col("after"), said("K01", SUGGESTED, F.concat(F.lit("-> "), trimmed(F.col("after"))), True, F.col("before")))
    fix = lambda f: F.when(F.coalesce(f["suggested_fix"], F.lit("")) != "", F.concat(quoted(f["suggested_fix"]), F.lit(" — "))).otherwise("")
    flagged = F.transform("flags", lambda f: said("K02", FLAGGED, F.concat(fix(f), f["reason"]), False, F.coalesce(f["original_text"], F.lit(""))))
    found = F.filter(F.concat(F.array(changed), flagged), lambda x: x.isNotNull())
    return answered.select("file_id", "idx", "line_no", F.explode(found).alias("f")).select("file_id", "idx", "line_no", "f.*")
