"""Line-first quality cleaning, in built-in column functions only.

Each line with a word is judged by itself: it fails when it lacks terminal punctuation, looks like
navigation, carries a boilerplate phrase or is mostly symbols. Failing lines are removed; a document
that loses more than ``max_loss`` of its word characters this way is rejected. Documents that fail the
base limits (too few words, too much repeated wording) are rejected before that.

Edge cases: a null or empty text has no words and is rejected by the base limits; lines without a word
are neither judged nor counted as loss; very long lines and texts are judged whole; duplicate rows give duplicate
results; an empty table gives an empty result; other columns of the input are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, one_space, table, without, words

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Marks that may end a line, and marks that may follow these.
TERMINAL = [".", "!", "?", "\u2026", ":", ";"]
CLOSING = "\"'\u201d\u2019\u00bb)]"
#: Menus, breadcrumb marks and phrases of page furniture (compared in lower case).
MENU = r"home|menu|login|log in|sign in|sign up|next|previous|back|search|share|contact|about|sitemap"
BETWEEN = r"[\s|>/\u00bb\u203a\u2022-]+"
BREADCRUMB = "|>\u00bb\u203a\u2022"
BOILERPLATE = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "lorem ipsum", "subscribe to our", "click here"]


def has_phrase(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def line_parts(line: Column) -> Column:
    """What several rules look at, made once for each line: lambdas share no common parts."""
    return F.struct(line.alias("line"), F.lower(line).alias("low"), F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")).alias("bare"))


def line_verdict(parts: Column, max_symbol_share: float = 0.1) -> Column:
    """Name of the rule that removes the line of ``line_parts``, or null if it stays."""
    line, bare = parts["line"], parts["bare"]
    length = F.length(bare)
    marks = length - F.length(without(bare, BREADCRUMB))
    blanks = F.length(line) - F.length(without(line, " \t\x0b\x0c\r"))
    end = F.right(F.when(F.right(bare, F.lit(1)).isin(*CLOSING), F.rtrim(bare, F.lit(CLOSING))).otherwise(bare), F.lit(1))
    # Nothing but menu words and what stands between them, however long: two linear passes, the second for few lines.
    menu = bare.rlike(f"^(?i:{MENU})") & (F.length(F.regexp_replace(bare, f"(?i:{MENU})|{BETWEEN}", "")) == 0)
    sentence = F.contains(line, F.lit(". ")) | F.contains(line, F.lit("! ")) | F.contains(line, F.lit("? "))
    return (
        F.when(length == 0, F.lit(None).cast("string"))
        .when(has_phrase(parts["low"]), "boilerplate")
        .when(((marks > 0) & (marks * 3 > blanks)) | menu, "navigation")
        .when(length - F.length(without(bare, SYMBOLS)) > max_symbol_share * length, "symbols")
        .when(~end.isin(TERMINAL) & ~sentence, "punctuation")
    )


def _word_chars(text: Column) -> Column:
    return F.length(without(text, " \t\n\x0b\x0c\r"))


def window_hashes(tokens: Column, n: Column) -> Column:
    """64-bit hashes of the three-word windows, by position."""
    h = F.transform(tokens, lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_loss: float = 0.5, with_text: bool = False) -> DataFrame:
    """One row per document: base counts, rule counts, verdict and, if asked for, the cleaned text.

    Repeated words are those in a three-word window that the text has twice or more. Windows are sorted by
    hash only in texts where one repeats; runs of equal hashes give positions, and the union of three words
    from each is summed in order.
    """
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    base = base.select("*", words(F.col("q_text")).alias("q_words"))
    base = base.select("*", F.size("q_words").alias("q_n"), F.split("q_text", "\n", -1).alias("q_lines"))
    base = base.select("*", window_hashes(F.col("q_words"), F.col("q_n")).alias("q_h")).drop("q_words")
    lines = F.filter(F.col("q_lines"), lambda x: F.length(without(x, " \t\x0b\x0c\r")) > 0)
    base = base.select("*", lines.alias("q_full"), F.transform(F.transform("q_lines", line_parts), lambda x: F.struct(x["line"].alias("line"), line_verdict(x).alias("rule"))).alias("q_judged"))
    ordered = F.sort_array(F.transform("q_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    base = base.select("*", F.when(F.size(F.array_distinct("q_h")) < F.size("q_h"), ordered).alias("q_sorted")).drop("q_h")
    s = F.col("q_sorted")
    hits = F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"])))
    base = base.select("*", F.sort_array(F.transform(hits, lambda x: x["i"])).alias("q_hits")).drop("q_sorted")
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    covered = F.aggregate("q_hits", start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")))["sum"]
    base = base.select("*", F.coalesce(covered, F.lit(0)).alias("q_rep"))
    removed = F.filter("q_judged", lambda x: x["rule"].isNotNull())
    count = lambda rule: F.size(F.filter("q_judged", lambda x: x["rule"] == rule)).cast("long")
    lost = F.aggregate(removed, F.lit(0), lambda a, x: a + _word_chars(x["line"]))
    base = base.select("*", _word_chars(F.col("q_text")).cast("long").alias("word_chars"), lost.cast("long").alias("removed_chars"))
    failed = (F.col("q_n") < min_words) | (F.lit(100) * F.col("q_rep") > F.lit(max_repeat_percent) * F.col("q_n"))
    return base.select(
        F.col(id_col),
        F.col("q_n").cast("long").alias("n_words"),
        "word_chars",
        (F.length("q_text") - F.length(without(F.col("q_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("q_full") - F.size(F.array_distinct("q_full"))).cast("long").alias("n_dup_lines"),
        F.col("q_rep").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("removed_chars") <= max_loss * F.col("word_chars"))).alias("kept"),
        F.size(removed).cast("long").alias("n_lines_removed"),
        count("punctuation").alias("n_no_punctuation"),
        count("navigation").alias("n_navigation"),
        count("boilerplate").alias("n_boilerplate"),
        count("symbols").alias("n_symbol_lines"),
        "removed_chars",
        *([F.array_join(F.transform(F.filter("q_judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("cleaned")] if with_text else []),
    )

def clean(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents that pass, with failing lines gone and all their other columns; ``n_chars`` follows if present."""
    carried = docs.select(F.struct(*docs.columns).alias("q_row"), F.col(text_col).alias("q_in"))
    # A filter moves below projections and would there repeat all that the verdict is made of; below this column it can't.
    judged = judge(carried, "q_row", "q_in", with_text=True, **limits).select("*", F.rand(0).alias("q_stay"))
    kept = judged.filter(F.col("kept") & (F.col("q_stay") >= 0))
    values = {c: F.col(f"q_row.`{c}`") for c in docs.columns} | {text_col: F.col("cleaned")}
    if "n_chars" in values:
        values["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[v.alias(c) for c, v in values.items()])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
