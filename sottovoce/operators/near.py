"""Join of spans of time within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_MS = 16_384


def meeting(a: DataFrame, b: DataFrame, a_span: tuple[Column, Column], b_span: tuple[Column, Column]) -> DataFrame:
    """Rows of ``a`` and ``b`` of one file whose closed spans touch; only file_id may be a column of both.

    Both are dealt by file and cells of time, so a long file spreads and costs in proportion to what meets. A pair
    comes up once, in the cell where the later span begins.
    """

    def dealt(df: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
        df = df.select("*", low.alias(f"{name}_low"), F.greatest(low, high).alias(f"{name}_high"))
        cells = F.sequence(F.floor(F.col(f"{name}_low") / CELL_MS), F.floor(F.col(f"{name}_high") / CELL_MS))
        return df.withColumn("cell", F.explode(cells))

    met = dealt(a, "a", *a_span).join(dealt(b, "b", *b_span), ["file_id", "cell"])
    touch = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    once = F.col("cell") == F.floor(F.greatest("a_low", "b_low") / CELL_MS)
    return met.filter(touch & once).drop("cell", "a_low", "a_high", "b_low", "b_high")
