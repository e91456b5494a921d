"""Helpers shared by the corpus operators: scratch tables, whitespace words, columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of code points other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, which the session names; one in /tmp only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or "/tmp/sottovoce-checkpoints").rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts lineage, so a lost executor costs a re-read and not a recomputation, lets each reader
    prune columns, and gives the planner true sizes for its join choices.
    """
    path = f"{shared_folder(df.sparkSession)}/sottovoce/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_space(text: Column) -> Column:
    """Every white-space character that separates words becomes a plain space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Array of the words of WORD; a null text has none."""
    return F.array_remove(F.split(one_space(F.coalesce(text, F.lit(""))), " "), "")


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


@contextmanager
def batches_of(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n rows while something is being written in the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def blocks_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in ``column`` have at most ``size`` bytes together, or one row."""
    sums = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + size, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high
