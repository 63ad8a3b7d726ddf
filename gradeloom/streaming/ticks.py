"""Ticks as a stream, each bucket of time once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def tick_dedupe(ticks: DataFrame, seconds: int = 30, late: str = "2 minutes") -> DataFrame:
    """One row a bucket of ``seconds``: ticks (ts timestamp) that fall into a bucket seen before are dropped."""
    bucket = F.window("ts", f"{seconds} seconds")["start"].alias("bucket")
    return ticks.withWatermark("ts", late).select(bucket, "ts").dropDuplicatesWithinWatermark(["bucket"]).select("bucket")
