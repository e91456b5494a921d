"""Keys that a text shares with every text that contains it, so that containment is an equi-join and a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the heads by which parts are looked up; a part has the longest that it fills.
HEADS = (8, 4, 2, 1)


def head_size(part: Column) -> Column:
    size = F.lit(HEADS[-1])
    for n in reversed(HEADS[:-1]):
        size = F.when(F.length(part) >= n, n).otherwise(size)
    return size


def head_key(part: Column) -> Column:
    """The key of a part that is looked for; it must not be empty."""
    return F.concat(head_size(part).cast("string"), F.lit(":"), F.substring(part, F.lit(1), head_size(part)))


def sizes_of(parts: DataFrame, part: str) -> list[int]:
    """The head sizes in use, four at most."""
    return [r[0] for r in parts.select(head_size(F.col(part))).distinct().collect()]


def keys_in(text: Column, sizes: list[int]) -> Column:
    """The distinct keys of all parts of a text that have these head sizes."""

    def heads(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(f"{n}:"), F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[heads(n) for n in sizes]))
