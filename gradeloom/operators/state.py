"""State machines over whole tables: what a scheduled sweep, or a replay of events, makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.sources.adapter import seconds


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def expired_attempts(attempts: DataFrame, exams: DataFrame, now: str, most: int | None = None) -> DataFrame:
    """Running attempts whose exam's duration is over, with the state they pass to; ``most``: the oldest first, as one sweep takes."""
    e = exams.select(F.col("id").alias("exam_id"), "duration_seconds")
    rows = attempts.where("status = 'IN_PROGRESS'").join(e, "exam_id").where(F.col("started_at") + seconds(F.col("duration_seconds")) < at(now))
    rows = rows.select("id", "exam_id", F.lit("SUBMITTED").alias("status"), F.lit(True).alias("auto_submitted"), "started_at")
    return rows if most is None else rows.orderBy("started_at", "id").limit(most)


def exam_transitions(exams: DataFrame, now: str) -> DataFrame:
    """(id, before, after): scheduled exams that have opened become live, live ones that have closed are closed; one may do both at once.

    A scheduled exam without an opening time stays scheduled.
    """
    live = F.when((F.col("status") == "SCHEDULED") & (F.col("opens_at") <= at(now)), "LIVE").otherwise(F.col("status"))
    after = F.when((live == "LIVE") & (F.col("closes_at") <= at(now)), "CLOSED").otherwise(live)
    return exams.select("id", F.col("status").alias("before"), after.alias("after"))


def violation_states(violations: DataFrame, total_at: int = 10, tabs_at: int = 3, flag_at: int = 5) -> DataFrame:
    """(id, attempt_id, n, tabs, action) up to the first violation that ends an attempt's counting.

    Running counts by server time decide, in this order: total, tab switches (only at a tab switch), flag; a
    threshold of 0 is off.
    """
    w = Window.partitionBy("attempt_id").orderBy("server_ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    tab = F.col("type") == "TAB_SWITCH"
    c = violations.withColumns({"n": F.count("*").over(w), "tabs": F.count_if(tab).over(w)})
    reached = lambda x, k: F.lit(k > 0) & (x >= k)
    action = F.when(reached(F.col("n"), total_at) | (tab & reached(F.col("tabs"), tabs_at)), "AUTO_SUBMIT").when(reached(F.col("n"), flag_at), "FLAG").otherwise("NONE")
    c = c.withColumn("action", action)
    over = F.max((F.col("action") != "NONE").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("__over", over).where(F.coalesce("__over", F.lit(0)) == 0).select("id", "attempt_id", "n", "tabs", "action")


def upserted_answers(writes: DataFrame) -> DataFrame:
    """(attempt_id, question_id, last values): the last write of each answer counts; time and verdict that it omits keep the last given ones."""
    order = F.struct("saved_at", "line_no", "time_spent")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return writes.groupBy("attempt_id", "question_id").agg(F.max("saved_at").alias("saved_at"), last("time_spent"), last("is_correct"), F.count("*").alias("writes"))


def heartbeats(attempts: DataFrame, exams: DataFrame, client_left: Column, now: str) -> DataFrame:
    """(id, server_left, stored, auto_submit): seconds that a running attempt has left: duration less whole seconds since its start,
    never below 0; the smaller of that and what the client says is stored, and an attempt without time is handed in."""
    e = exams.select(F.col("id").alias("exam_id"), "duration_seconds")
    elapsed = F.floor((F.unix_micros(at(now).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000)
    left = F.greatest(F.lit(0), F.col("duration_seconds") - elapsed).cast("long")
    rows = attempts.where("status = 'IN_PROGRESS'").join(e, "exam_id").withColumn("server_left", left).withColumn("client_left", client_left.cast("long"))
    return rows.select("id", "server_left", F.least("server_left", F.coalesce("client_left", "server_left")).alias("stored"), (F.col("server_left") <= 0).alias("auto_submit"))


def touched(answers: DataFrame, attempts: DataFrame, graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of graded attempts (id) changes: (question_id) of their answers, (student_id) of theirs; to recompute only these."""
    ids = graded.select(F.col("id").alias("attempt_id")).distinct()
    questions = answers.join(ids, "attempt_id", "left_semi").select("question_id").distinct()
    students = attempts.join(ids, attempts["id"] == ids["attempt_id"], "left_semi").select("student_id").distinct()
    return questions, students


def due_mail(notifications: DataFrame, attempts: int = 5) -> DataFrame:
    """E-mails that are neither sent nor given up."""
    return notifications.where((F.col("channel") == "EMAIL") & F.col("sent_at").isNull() & F.col("failed_at").isNull() & (F.col("attempt_count") < attempts))


def outbox(notifications: DataFrame, delivered: Column, most: int = 100, attempts: int = 5) -> DataFrame:
    """(id, attempt_count, sent, failed): one sweep over the oldest unsent e-mails: those delivered are sent, others count an attempt
    and have failed at the fifth."""
    batch = due_mail(notifications, attempts).orderBy("created_at", "id").limit(most).withColumn("sent", delivered)
    count = F.col("attempt_count") + F.when(F.col("sent"), 0).otherwise(1)
    return batch.select("id", count.cast("int").alias("attempt_count"), "sent", (~F.col("sent") & (count >= attempts)).alias("failed"))


def ticks(events: DataFrame, column: str, width: int = 30) -> DataFrame:
    """(bucket, n): ticks by buckets of ``width`` seconds since the epoch; a bucket is done once."""
    return events.groupBy(F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / width).alias("bucket")).agg(F.count("*").alias("n"))


def stuck_uploads(uploads: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    """(id, status): uploads in processing that nothing has touched for so long have failed."""
    rows = uploads.where("status = 'PROCESSING'").where(F.col("updated_at") < at(now) - seconds(F.lit(60 * minutes)))
    return rows.select("id", F.lit("FAILED").alias("status"))


def new_callbacks(callbacks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Callbacks (job_id, ...) of jobs that are neither finished nor have drafts (jobs: job_id, finished, drafts); a repeated one counts once."""
    done = jobs.where(F.col("finished") | (F.col("drafts") > 0)).select("job_id")
    return callbacks.dropDuplicates(["job_id"]).join(done, "job_id", "left_anti")


def merged_progress(patches: DataFrame, by: str, *order: str) -> DataFrame:
    """Progress patches, one after the other: each field has the last value that was given for it."""
    fields = [c for c in patches.columns if c not in (by, *order)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)
    return patches.groupBy(by).agg(*[last(c) for c in fields], F.count("*").alias("patches"))


def rate_limited(events: DataFrame, by: str, column: str, most: int = 60, width: int = 10) -> DataFrame:
    """(by, bucket, n, over): events of windows of ``width`` seconds, and how many exceed the limit."""
    g = events.groupBy(by, F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / width).alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("over", F.greatest(F.lit(0), F.col("n") - most))
