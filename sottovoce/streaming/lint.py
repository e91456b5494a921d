"""Linting of cue files as they arrive: the checks of single cues keep no state, so they run on a stream as they are."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sottovoce.operators.checks import findings

CUES = "file_id long, idx int, start_ms long, end_ms long, text string"


def lint_stream(spark: SparkSession, folder: str, profile: Mapping[str, Any]) -> DataFrame:
    """Findings of the Parquet cue files that appear in ``folder``; the caller starts the sink with its checkpoint."""
    return findings(spark.readStream.schema(CUES).parquet(folder), profile)
