"""The platform's queues as Structured Streaming jobs. Rules come from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_states(writes: DataFrame) -> DataFrame:
    """A stream or table of writes (attempt_id, question_id, saved_at, time_spent, is_correct) -> the state of each answer.

    The last write counts; values that it omits keep the last given ones. In update mode a trigger gives what changed.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("saved_at"))).alias(c)
    return writes.groupBy("attempt_id", "question_id").agg(F.max("saved_at").alias("saved_at"), last("time_spent"), last("is_correct"))


def requests_over(events: DataFrame, by: str, most: int = 60, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """A stream of requests (by, ts) -> windows of ``seconds`` and how many requests exceed the limit; for append mode."""
    g = events.withWatermark("ts", late).groupBy(by, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("over"))


def progress_states(patches: DataFrame, by: str = "job_id") -> DataFrame:
    """A stream of progress patches (job_id, ts, fields) -> each field's last given value, and when a job was last heard of."""
    fields = [c for c in patches.columns if c not in (by, "ts")]
    return patches.groupBy(by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in fields], F.max("ts").alias("heard_at"))
