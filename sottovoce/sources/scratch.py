"""Tables that cut lineage, in the folder that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def scratch(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to a fresh table under ``spark.checkpoint.dir`` and read back; /tmp only in a local session that names no folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(folder or '/tmp/sottovoce-checkpoints').rstrip('/')}/sottovoce/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
