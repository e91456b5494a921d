"""A corpus pipeline: cleaning, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``. Near-duplicates use five-word
shingles at a similarity of 0.8.

Edge cases: null and empty texts have under 50 words, so the quality rules reject them; a null source is a source of its
own; repeated rows are near-duplicates of each other, and as they share an id they stay or go together; null ids are
carried, and near-duplicates keep them; texts of any length are judged, cut, compared and packed whole; an empty table
gives an empty result; further columns of the documents, of whatever name, are carried up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from sottovoce.llm.common import scratch, table, without


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others are cut."""
    return quality_rules.clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line passages are cut; a document that loses all its text goes with them."""
    out = line_dedup.cut_passages(docs)
    emptied = (F.col("removed") > 0) & (F.length(without(F.col("text"), " \t\n\x0b\x0c\r")) == 0)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.filter(~emptied).select(*[v.alias(c) for c, v in values.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id."""
    gone = scratch(near_dedup.near_duplicates(docs, width=5, percent=80).filter("not kept").select("id"), "near-gone")
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more; small sources are repeated up to 1.5 times."""
    return mixing.mixed_documents(docs, max_repeats=1.5)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality rules", clean_lines),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Near-duplicate search and tokenisation have no SQL form; a test holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
