"""Removal of repeated three-line passages across a corpus, in built-in column functions only.

Every window of three consecutive lines is hashed to 128 bits. A window that occurs more than once in the
corpus stays where it comes first, by (document id, line), and its later occurrences cover their three lines;
covered lines of a document are merged into intervals and cut out. A passage that overlaps its own repetition, as in
five equal lines, keeps the three lines of its first occurrence.

Only windows that repeat are written to a table, with one row each; later occurrences find them by a join that
can be split where one passage is very frequent. No group is ever gathered by window.

Edge cases: null or empty texts and texts of fewer than three lines stay as they are; windows of three blank
lines are ignored; rows that agree in id and text count as one document and so keep or lose lines together;
null ids come first; texts and lines of any length are read whole; an empty table gives an empty result; other columns are
carried along, and columns of the names d_lines and d_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, without


def _key(id_col: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text; never null."""
    said = F.coalesce(id_col.cast("string"), F.lit("\0"))
    return F.struct(F.xxhash64(said, text).alias("a"), F.xxhash64(text, F.lit(1), said).alias("b"))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, pos, h): every three-line window with its 128-bit hash; pos counts lines from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The size keeps the array of line hashes a column of its own, made once and not in each window.
    lines = docs.select(F.col(id_col).alias("id"), _key(F.col(id_col), text).alias("key"), F.split(text, "\n", -1).alias("w_lines"))
    hashed = lines.filter(F.size("w_lines") >= 3).select("id", "key", F.transform("w_lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (F.length(without(x, " \t\x0b\x0c\r")) > 0).alias("full"))).alias("w_hash"))
    each = hashed.select("id", "key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w_hash") - 3), lambda i: F.slice("w_hash", i + 1, F.lit(3)))).alias("pos", "w"))
    a, b, c = (F.col("w")[i] for i in range(3))
    return each.filter(a["full"] | b["full"] | c["full"]).select("id", "key", "pos", F.struct(F.xxhash64(a["a"], b["a"], c["a"]).alias("a"), F.xxhash64(a["b"], b["b"], c["b"]).alias("b")).alias("h"))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, pos, own) of every window that has occurred before; own is where it came first in the same document, if it did."""
    all_windows = windows(docs, id_col, text_col)
    place = F.struct("id", "key", "pos")
    repeated = scratch(all_windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first"), "line-windows")
    own = F.when(F.col("first.key") == F.col("key"), F.col("first.pos"))
    return all_windows.join(repeated, "h").filter(~place.eqNullSafe(F.col("first"))).select("key", "pos", own.alias("own"))


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, lines, removed): a struct of the columns of ``docs`` except the text, the cut text, and how many lines it had and lost."""
    lines_of = lambda pos: F.flatten(F.transform(pos, lambda p: F.array(p, p + 1, p + 2)))
    later = later_windows(docs, id_col, text_col).groupBy("key").agg(F.collect_set("pos").alias("pos"), F.collect_set("own").alias("own"))
    cut = later.select("key", F.sort_array(F.array_except(lines_of(F.col("pos")), lines_of(F.col("own")))).alias("c_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]
    carried = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("c_text"), _key(F.col(id_col), text).alias("key"))
    joined = carried.join(cut, "key", "left").select("row", "c_text", "c_gone", F.split("c_text", "\n", -1).alias("c_lines"))
    p = F.col("c_gone")
    starts = F.filter(p, lambda x, i: (i == 0) | (x > F.get(p, F.greatest(i - 1, F.lit(0))) + 1))
    ends = F.transform(F.filter(p, lambda x, i: F.get(p, i + 1).isNull() | (F.get(p, i + 1) > x + 1)), lambda x: x + 1)
    joined = joined.select("*", starts.alias("c_from"), ends.alias("c_to"), F.size("c_lines").alias("c_n"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("c_from")), lambda i: _between(F.col("c_lines"), F.when(i == 0, 0).otherwise(F.get("c_to", F.greatest(i - 1, F.lit(0)))), F.coalesce(F.get("c_from", i), F.col("c_n")))))
    cleaned = F.when(F.size(F.coalesce(p, F.array().cast("array<int>"))) == 0, F.col("c_text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("c_text").isNull(), 0).otherwise(F.col("c_n"))
    return joined.select("row", cleaned.alias("text"), n.cast("long").alias("lines"), F.coalesce(F.size(p), F.lit(0)).cast("long").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cut, and d_lines, d_removed (long) beside its columns."""
    out = cut_passages(docs, id_col, text_col)
    values = [(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in ("d_lines", "d_removed")]
    return out.select(*values, F.col("lines").alias("d_lines"), F.col("removed").alias("d_removed"))


def _between(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, end - start)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("d_lines").alias("n_lines"), F.col("d_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


SQL = r"""with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, pos, [ls[pos + 1], ls[pos + 2], ls[pos + 3]] as h from (select doc_id, ls, unnest(range(0, len(ls) - 2)) as pos from l where len(ls) >= 3)),
f as (select h, min({'d': doc_id, 'p': pos}) as first from w where len(list_filter(h, lambda x: length(translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0)) > 0 group by h having count(*) > 1),
c as (select w.doc_id, pos, case when w.doc_id = first.d then first.p end as own from w join f on w.h = f.h where not (w.doc_id = first.d and pos = first.p)),
n as (select doc_id, list(line) as gone from (select doc_id, unnest([pos, pos + 1, pos + 2]) as line from c except select doc_id, unnest([own, own + 1, own + 2]) from c where own is not null) group by doc_id),
k as (select l.doc_id, len(ls) as n, coalesce(len(gone), 0) as r, case when gone is null then text else array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as t from l left join n on l.doc_id = n.doc_id)
select doc_id, coalesce(n, 0)::bigint as n_lines, r::bigint as n_removed, length(t)::bigint as kept_chars, md5(t) as kept_md5 from k"""
QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE = {"op1_line_dedup": SQL}
