"""Look-ups in offline reference tables: effect lexicon, wiki pages, and readable reports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Particles cut from the end of a word, and words that say nothing about a sound.
PARTICLES = r"(에서|으로|이|가|을|를|은|는|에|의|로|와|과|도)$"
EMPTY_WORDS = ["소리", "효과음", "나는", "하는", "들리는"]


def effect_tokens(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit("([가-힣]{2,})"), F.lit(1)), lambda w: F.when(F.length(w) > 2, F.regexp_replace(w, PARTICLES, "")).otherwise(w))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(EMPTY_WORDS))


#: Fixed value: how suggestions are put.
HINT = "이렇게 쓸 수 있습니다: "


def with_effect_hints(found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Findings whose detail is an effect marker, with what the lexicon suggests for it; markers are looked up once each."""
    markers = found.select(F.col("detail").alias("marker")).distinct()
    ranked = effect_suggestions(markers, lexicon).groupBy("marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    hinted = found.join(ranked, F.col("detail") == F.col("marker"), "left")
    detail = F.when(F.col("terms").isNull(), F.col("detail")).otherwise(F.concat("detail", F.lit(" — " + HINT), F.array_join("terms", " / ")))
    return hinted.select(*[detail.alias("detail") if c == "detail" else F.col(c) for c in found.columns])


def effect_suggestions(markers: DataFrame, lexicon: DataFrame, limit: int = 3) -> DataFrame:
    """(marker, term, rank): lexicon entries that share words (by prefix) with a marker, the first word counting twice.

    Words meet on their first two characters, so no pair is formed without a common prefix.
    """
    m = markers.select("marker").distinct().withColumn("words", effect_tokens(F.col("marker")))
    m = m.select("marker", F.posexplode("words").alias("at", "w")).withColumn("p", F.substring("w", 1, 2))
    t = lexicon.select("term", F.explode(F.array_distinct(effect_tokens(F.col("term")))).alias("t")).withColumn("p", F.substring("t", 1, 2))
    hit = m.join(t, "p").filter((F.startswith("t", F.col("w")) | F.startswith("w", F.col("t"))) & (F.col("term") != F.col("marker"))).select("marker", "term", "at").distinct()
    scored = hit.groupBy("marker", "term").agg((F.count("*") + F.max((F.col("at") == 0).cast("int"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("marker").orderBy(F.col("score").desc(), F.length("term"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("marker", "term", "rank")


#: What is dropped from a wiki value or put in its place, in this order, and the marks without which there is none.
WIKI = [
    (re.compile(r"<ref[^>]*?/>"), "", ["<"]), (re.compile(r"(?s)<ref[^>]*?>.*?</ref>"), "", ["<"]), (re.compile(r"(?s)<!--.*?-->"), "", ["<"]), (re.compile(r"(?i)<br\s*/?>"), " ", ["<"]), (re.compile(r"<[^>]+>"), "", ["<"]),
    (re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]"), r"\1", ["[["]), (re.compile(r"\[\[|\]\]|'{2,3}"), "", ["[[", "]]", "''"]),
]
LIST_MARK, EDGES, TEMPLATES = re.compile(r"\s*[*•]\s*"), " /*•-", 8
BOX = re.compile(r"\{\{\s*[^|}\n]*[Ii]nfobox")
INNERMOST = re.compile(r"\{\{([^{}]*)\}\}")


def _readable(value: str) -> str:
    """A wiki value as text. Of a template what is said stays: its arguments without a name."""
    # A pattern is tried only where its mark is.
    for pattern, instead, marks in WIKI:
        if any(m in value for m in marks):
            value = pattern.sub(instead, value)
    said = lambda m: f" {' '.join(a for a in m[1].split('|')[1:] if '=' not in a)} "
    for _ in range(TEMPLATES):
        value, found = INNERMOST.subn(said, value, count=1)
        if not found:
            break
    return LIST_MARK.sub(" / ", re.sub(r"\s+", " ", value)).strip(EDGES)


def _closing(page: str, start: int) -> int:
    """Where the template that opens at ``start`` ends."""
    depth = 0
    for mark in re.compile(r"\{\{|\}\}").finditer(page, start):
        depth += 1 if mark[0] == "{{" else -1
        if depth == 0:
            return mark.end()
    return len(page)


def _fields(page: str) -> dict[str, str]:
    """Fields of the first infobox of a page; bars inside links and inner templates do not separate."""
    start = BOX.search(page or "")
    if not start:
        return {}
    box = page[start.start() : _closing(page, start.start())][2:-2]
    braces = brackets = 0
    bars = []
    for mark in re.finditer(r"[{}\[\]|]", box):
        braces += (mark[0] == "{") - (mark[0] == "}")
        brackets += (mark[0] == "[") - (mark[0] == "]")
        if mark[0] == "|" and braces == brackets == 0:
            bars.append(mark.start())
    named = (box[a + 1 : b].partition("=") for a, b in zip(bars, [*bars, len(box)][1:], strict=True))
    values = ((key.strip().lower(), _readable(value)) for key, there, value in named if there and key.strip())
    return {key: value for key, value in values if value}


def infobox(page: Column) -> Column:
    """MAP of the fields of a page's infobox."""

    @F.pandas_udf("map<string,string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(_fields)

    return run(page)


def pick(fields: Column, keys: list[str]) -> Column:
    """The first of ``keys`` that has a value."""
    return F.coalesce(*[F.element_at(fields, k) for k in keys])


def cast_research(people: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, description, note): the page of exactly this title among the first three hits, else the first; what is known stays."""
    hits = people.join(pages.filter("rank <= 3").select(F.col("query"), "title", "rank", F.col("description").alias("found")), F.col("name") == F.col("query"), "left")
    exact = (F.lower("title") == F.lower("name")).cast("int")
    order = Window.partitionBy("name").orderBy(exact.desc_nulls_last(), "rank")
    best = hits.withColumn("r", F.row_number().over(order)).withColumn("hits", F.count("title").over(Window.partitionBy("name"))).filter("r = 1")
    return best.select("name", F.coalesce("description", "found").alias("description"), F.when(F.col("hits") > 1, F.concat("hits", F.lit(" pages"))).alias("note"))


def _listed(rows: DataFrame, order: list[Column], line: Column, name: str) -> DataFrame:
    """(file_id, name): the lines of each file in order."""
    return rows.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))), lambda x: x["line"]).alias(name))


def report_text(
    files: DataFrame, found: DataFrame, header: str, basis: str | None = None, warnings: DataFrame | None = None, suggestions: DataFrame | None = None, unimplemented: DataFrame | None = None, skipped: tuple[str, ...] = (), shown: int = 8
) -> DataFrame:
    """(file_id, report): a readable report of each of ``files`` (file_id, name), also of those without findings.

    It says by which profile and source was judged, all findings, their counts by rule, ``shown`` of the suggestions and
    how many more there are, what is not implemented and what could not run.
    """
    none = F.array().cast("array<string>")
    pad = "              "

    def line(x: Column, rule: Column) -> Column:
        where = F.concat(F.lit("#"), x["idx"], F.when(x["line_no"].isNotNull(), F.concat(F.lit(" "), x["line_no"], F.lit("행"))).otherwise(""))
        wide = F.concat(F.repeat(F.lit(" "), F.greatest(10 - F.length(where), F.lit(0))), where)
        detail = F.when(F.startswith(x["detail"], F.lit("->")), x["detail"]).otherwise(F.concat(F.lit("-> "), x["detail"]))
        return F.concat_ws(
            "\n", F.concat(F.lit("  ["), F.when(x["auto"], "자동").otherwise("확인"), F.lit("] "), wide, F.lit("  "), rule["rule_id"], F.lit(" "), x["clause"]),
            F.when(x["excerpt"] != "", F.concat(F.lit(f"{pad}| "), x["excerpt"])), F.concat(F.lit(pad), rule["message"]), F.when(x["detail"] != "", F.concat(F.lit(pad), detail)),
        )

    def counted(rule: Column) -> Column:
        number = F.size(rule["rows"]).cast("string")
        return F.concat(F.lit("    "), F.repeat(F.lit(" "), F.greatest(4 - F.length(number), F.lit(0))), number, F.lit("건  "), rule["rule_id"], F.lit("  "), rule["message"])

    # Findings are made once and dealt by file without what they share; lines and counts are made of them there.
    by_rule = found.select("file_id", "rule_id", "message", "idx", "line_no", "auto", "clause", "excerpt", "detail").repartition("file_id").groupBy("file_id", "rule_id", "message").agg(F.collect_list(F.struct("idx", "line_no", "auto", "clause", "excerpt", "detail")).alias("rows"))
    by_file = by_rule.groupBy("file_id").agg(F.collect_list(F.struct("rule_id", "message", "rows")).alias("rules"))
    lines = F.flatten(F.transform("rules", lambda r: F.transform(r["rows"], lambda x: F.struct(x["idx"].alias("o0"), r["rule_id"].alias("o1"), F.coalesce(x["line_no"], F.lit(0)).alias("o2"), line(x, r).alias("line")))))
    counts = F.transform("rules", lambda r: F.struct((-F.size(r["rows"])).alias("o0"), r["rule_id"].alias("o1"), r["message"].alias("o2"), counted(r).alias("line")))
    said = lambda rows: F.transform(F.sort_array(rows), lambda x: x["line"])
    out = files.select("file_id", "name").join(by_file.select("file_id", said(lines).alias("findings"), said(counts).alias("counts")), "file_id", "left")
    if warnings is not None:
        out = out.join(_listed(warnings, [F.col("warning")], F.concat(F.lit("  ⚠ "), "warning"), "warned"), "file_id", "left")
    if suggestions is not None:
        each = F.struct("idx", "field", "current", "suggested")
        out = out.join(suggestions.groupBy("file_id").agg(F.sort_array(F.collect_list(each)).alias("suggested")), "file_id", "left")
    missing = none
    if unimplemented is not None:
        # One row, of the labels of a profile.
        names = unimplemented.agg(F.array_sort(F.collect_set("label")).alias("missing"))
        out = out.join(F.broadcast(names), F.lit(True))
        missing = F.when(F.size("missing") > 0, F.array(F.concat(F.lit("  미구현 검사 "), F.size("missing").cast("string"), F.lit("건: "), F.array_join("missing", ", ")))).otherwise(none)
    some = lambda c: F.coalesce(F.col(c), none)
    head = F.array(F.concat("name", F.lit(f" — {header}")), *([F.lit(f"  기준: {basis}")] if basis else []))
    by_rule = F.when(F.col("counts").isNotNull(), F.concat(F.array(F.lit("  규칙별 집계")), some("counts"), F.array(F.lit("")))).otherwise(none)
    parts = [head, some("warned") if warnings is not None else none, F.coalesce("findings", F.array(F.lit("  위반 없음"))), F.array(F.lit("")), by_rule, F.array(F.concat(F.lit("  위반 "), F.coalesce(F.size("findings"), F.lit(0)).cast("string"), F.lit("건")))]
    if suggestions is not None:
        n = F.size("suggested")
        first = F.transform(F.slice("suggested", 1, shown), lambda x: F.concat(F.lit("    #"), x["idx"], F.lit(" "), x["field"], F.lit(" "), x["current"], F.lit(" -> "), x["suggested"], F.lit("ms")))
        more = F.when(n > shown, F.array(F.concat(F.lit("    … 외 "), (n - shown).cast("string"), F.lit("건")))).otherwise(none)
        parts.append(F.when(F.col("suggested").isNotNull(), F.concat(F.array(F.concat(F.lit("  스포팅 제안 "), n.cast("string"), F.lit("건 (자동 적용 안 함)"))), first, more)).otherwise(none))
    parts += [missing, F.array(*[F.lit(f"  돌지 못한 검사: {r}") for r in skipped]).cast("array<string>")]
    return out.select("file_id", F.array_join(F.concat(*parts), "\n").alias("report"))
