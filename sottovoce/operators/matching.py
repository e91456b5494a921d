"""One-to-one matching of two tracks, in rounds over islands of candidates.

Reference cues choose in their order, each the best cue still free. All of our cues thus prefer the earlier reference
cue, and offers in rounds end in the same pairs: every open reference cue offers to its best candidate, a cue keeps the
earliest offer and is out of reach for all later reference cues. An island is a stretch of reference cues whose
candidates no cue outside shares. Islands in which no cue has two offers are done; the others go to the next round,
so a round is two aggregations and a join over what is still contested, however long a file is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sottovoce.sources.scratch import scratch


def with_islands(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the place, among the turns of their file, at which their island begins."""
    in_file = Window.partitionBy("file_id")
    # Rows are dealt by file once, and all numbers are windows over them.
    placed = pairs.withColumn("at", F.dense_rank().over(in_file.orderBy("turn"))).withColumn("reach", F.max("at").over(Window.partitionBy("file_id", "o_idx")))
    earlier, so_far = in_file.orderBy("at").rangeBetween(Window.unboundedPreceding, -1), in_file.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.max("reach").over(earlier) < F.col("at"), F.lit(True))
    return placed.withColumn("begins", F.when(begins, F.col("at"))).withColumn("island", F.max("begins").over(so_far)).drop("at", "reach", "begins")


def in_turn(pairs: DataFrame) -> DataFrame:
    """Of (file_id, t_idx, o_idx, turn, wish, score) the pairs in which each reference cue, by turn, has the free cue of least wish.

    ``turn`` orders the reference cues of a file, ``wish`` the candidates of one; both are unique there.
    """
    open_, done = scratch(with_islands(pairs), "candidates"), []
    while True:
        offers = open_.groupBy("file_id", "island", "t_idx", "turn").agg(F.min_by(F.struct("o_idx", "score"), "wish").alias("best"))
        offers = offers.select("file_id", "island", "t_idx", "turn", "best.*")
        kept = offers.groupBy("file_id", "island", "o_idx").agg(F.min("turn").alias("first"), F.count("*").alias("n"))
        kept = scratch(kept, "offers")
        contested = kept.filter("n > 1").select("file_id", "island").distinct()
        if contested.isEmpty():
            done.append(offers)
            break
        done.append(offers.join(contested, ["file_id", "island"], "left_anti"))
        left = open_.join(contested, ["file_id", "island"]).join(kept.drop("n"), ["file_id", "island", "o_idx"], "left")
        open_ = scratch(left.filter("first is null or turn <= first").drop("first"), "candidates")
    return reduce(DataFrame.unionByName, done).select("file_id", F.col("o_idx").alias("our_idx"), F.col("t_idx").alias("truth_idx"), "score")
