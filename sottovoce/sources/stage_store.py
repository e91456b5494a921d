"""Stages of many works: every step's cues as a table, and a record of each step for each file.

A step is written first and recorded then, by appending to the manifest, so a run that dies in between leaves no step
behind and the step before is still the last one. A step that is saved again takes its own place: the latest record
counts, and its order stays. The first recorded save of a file fixes its timecodes; later steps record how many cues have
moved, for which the times of both saves, and no texts, are dealt by file once.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "file_id long, step string, save string, nth long, seq long, saved_at timestamp, cues long, model string, seconds double, note string, moved_count long, moved array<int>"
#: How many moved cues a record names.
NAMED = 20


def _times(kept: DataFrame, nth: int) -> DataFrame:
    return kept.select(F.col("file_id").cast("long").alias("file_id"), F.lit(nth).cast("long").alias("nth"), F.col("idx").cast("int").alias("idx"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


def _compared(times: DataFrame, nth: int) -> DataFrame:
    """(file_id, cues, first_cues, differ, moved) of the files in save ``nth``: its cues beside those of the file's first save, by place."""
    by_save = Window.partitionBy("file_id").orderBy("nth", "idx").rowsBetween(Window.unboundedPreceding, 0)
    t = times.repartition("file_id").withColumn("first", F.first("nth").over(by_save)).withColumn("at", F.row_number().over(Window.partitionBy("file_id", "nth").orderBy("idx")))
    t = t.filter((F.col("nth") == nth) | (F.col("nth") == F.col("first")))
    # Of one place, the first save comes before this one.
    by_place = Window.partitionBy("file_id").orderBy("at", "nth")
    is_now, cue = F.col("nth") == nth, F.struct("idx", "start_ms", "end_ms")
    t = t.withColumn("was", F.lag(F.struct("at", cue.alias("cue"))).over(by_place))
    t = t.withColumn("differs", is_now & F.coalesce((F.col("was.at") == F.col("at")) & (F.col("was.cue") != cue), F.lit(False)))
    t = t.withColumn("rank", F.sum(F.col("differs").cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    named = F.collect_list(F.when(F.col("differs") & (F.col("rank") <= NAMED), F.struct("at", "idx")))
    found = t.groupBy("file_id").agg(
        F.count(F.when(is_now, 1)).alias("cues"), F.count(F.when(F.col("nth") == F.col("first"), 1)).alias("first_cues"), F.count(F.when(F.col("differs"), 1)).alias("differ"),
        F.transform(F.array_sort(named), lambda x: x["idx"]).alias("moved"),
    )
    return found.filter("cues > 0")


class StageStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the store; empty before its first save."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # there is no such folder yet
            return self.spark.createDataFrame([], schema)

    def save(self, cues: DataFrame, step: str, *, model: str = "", seconds: float | None = None, note: str = "") -> DataFrame:
        """Keep a step of all files in ``cues``, and a record for each of them; returns the cues as kept, which the next step may start from."""
        records, path, save = self._table("manifest", RECORD), f"{self.folder}/steps/step={step}", uuid.uuid4().hex
        # Few rows: one for each save that was the first of some file.
        first = records.groupBy("file_id").agg(F.min(F.struct("nth", "step", "save")).alias("f")).select("f.*").distinct().collect()
        nth = (records.agg(F.max("nth")).first()[0] or 0) + 1
        cues.write.option("compression", "zstd").parquet(f"{path}/save={save}")
        kept = self.spark.read.schema(cues.schema).parquet(f"{path}/save={save}")
        low, high = kept.agg(F.min(F.col("file_id").cast("long")), F.max(F.col("file_id").cast("long"))).first()
        if low is None:  # no file, no record
            return kept
        now = _times(kept, nth).filter("file_id is not null")
        if first:
            earlier = [_times(self.spark.read.parquet(f"{self.folder}/steps/step={f.step}/save={f.save}"), f.nth).filter(F.col("file_id").between(low, high)) for f in first]
            rows = _compared(reduce(DataFrame.unionByName, earlier, now), nth)
        else:
            rows = now.groupBy("file_id").agg(F.count("*").alias("cues")).select("*", F.col("cues").alias("first_cues"), F.lit(0).alias("differ"), F.array().cast("array<int>").alias("moved"))
        order = records.groupBy("file_id").agg(F.max("seq").alias("last"), F.max(F.when(F.col("step") == step, F.col("seq"))).alias("own"))
        count = F.when(F.col("cues") == F.col("first_cues"), F.col("differ")).otherwise(F.abs(F.col("cues") - F.col("first_cues")))
        rows.join(order, "file_id", "left").select(
            "file_id", F.lit(step).alias("step"), F.lit(save).alias("save"), F.lit(nth).cast("long").alias("nth"), F.coalesce("own", F.col("last") + 1, F.lit(1)).cast("long").alias("seq"), F.current_timestamp().alias("saved_at"), "cues", F.lit(model).alias("model"),
            F.lit(seconds).cast("double").alias("seconds"), F.lit(note).alias("note"), count.cast("long").alias("moved_count"), "moved",
        ).write.mode("append").parquet(f"{self.folder}/manifest")
        return kept

    def steps(self) -> DataFrame:
        """The record of each step of each file; of a step that was saved again, the latest."""
        records = self._table("manifest", RECORD)
        latest = F.max("nth").over(Window.partitionBy("file_id", "step"))
        return records.withColumn("latest", latest).filter("nth = latest").drop("latest")

    def _cues(self, wanted: DataFrame) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/steps").schema("file_id long, idx int, start_ms long, end_ms long, text string, step string, save string").parquet(f"{self.folder}/steps").join(wanted.select("file_id", "step", "save"), ["file_id", "step", "save"]).drop("save")

    def read(self, step: str) -> DataFrame:
        """The cues of a step, each file's as saved last."""
        return self._cues(self.steps().filter(F.col("step") == step)).drop("step")

    def last(self) -> DataFrame:
        """The record of the last step that each file has reached."""
        newest = F.max("seq").over(Window.partitionBy("file_id"))
        return self.steps().withColumn("newest", newest).filter("seq = newest").drop("newest")

    def resume(self) -> DataFrame:
        """The cues of the last step of each file, with the step's name: where work goes on."""
        return self._cues(self.last())

    def save_source(self, source: DataFrame, step: str = "01-source") -> None:
        """Source texts (file_id, idx, text) by number; an earlier table of the same name is replaced."""
        source.select("file_id", "idx", "text").write.mode("overwrite").parquet(f"{self.folder}/sources/{step}")

    def read_source(self, step: str = "01-source") -> DataFrame:
        return self._table(f"sources/{step}", "file_id long, idx int, text string")


def summary(store: StageStore) -> DataFrame:
    """(file_id, summary): a paragraph for each file, its steps in order, with a warning where timecodes have moved."""
    bits = F.concat_ws(" · ", F.concat(F.lit("자막 "), "cues", F.lit("개")), F.when(F.col("model") != "", F.col("model")), F.when(F.col("seconds").isNotNull(), F.concat(F.round("seconds", 1).cast("string"), F.lit("초"))))
    named = F.array_join(F.transform(F.slice("moved", 1, 5), lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")
    warning = F.when(F.col("moved_count") > 0, F.concat(F.lit("\n  [경고] 타임코드가 "), "moved_count", F.lit("곳 움직였습니다: "), named)).otherwise("")
    line = F.concat("step", F.lit(" "), bits, F.when(F.col("note") != "", F.concat(F.lit("\n  "), "note")).otherwise(""), warning)
    lines = store.steps().groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return lines.select("file_id", F.array_join("lines", "\n").alias("summary"))
