"""Streams that keep state of their own for each attempt or answer: violations, handing in, deltas of figures.

The session needs a state store that knows column families: ``state_store(spark)`` sets it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from gradeloom.functions.grading import grade
from gradeloom.operators import analytics as an
from gradeloom.operators import state as st
from gradeloom.sources.buckets import BucketTable


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- violations


class Violations(StatefulProcessor):
    """Counts of one attempt until an action ends them; events that come again by their id don't count."""

    def __init__(self, total_at: int, tabs_at: int, flag_at: int):
        self.limits = total_at, tabs_at, flag_at

    def init(self, handle):
        self.counts = handle.getValueState("counts", "n long, tabs long, ended boolean")
        self.seen = handle.getMapState("seen", "id long", "at long")

    def handleInputRows(self, key, rows, timerValues):
        total_at, tabs_at, flag_at = self.limits
        n, tabs, ended = self.counts.get() if self.counts.exists() else (0, 0, False)
        if ended:
            return
        for r in sorted(rows, key=lambda r: (r.us, r.id)):
            if self.seen.containsKey((r.id,)):
                continue
            self.seen.updateValue((r.id,), (r.us,))
            tab = r.type == "TAB_SWITCH"
            n, tabs = n + 1, tabs + tab
            over = (total_at > 0 and n >= total_at) or (tab and tabs_at > 0 and tabs >= tabs_at)
            action = "AUTO_SUBMIT" if over else "FLAG" if flag_at > 0 and n >= flag_at else "NONE"
            yield Row(id=r.id, attempt_id=key[0], n=n, tabs=tabs, action=action)
            if action != "NONE":  # nothing counts any more, so no id has to be known
                self.counts.update((n, tabs, True))
                self.seen.clear()
                return
        self.counts.update((n, tabs, False))

    def close(self):
        pass


def violation_stream(events: DataFrame, total_at: int = 10, tabs_at: int = 3, flag_at: int = 5) -> DataFrame:
    """A stream of violations (id, attempt_id, type, server_ts) -> what ``state.violation_states`` gives for them, each once.

    Events of a trigger go by server time, triggers one after the other; an event with a known id, or of an attempt
    whose counting has ended, gives nothing. A null id or time is no violation.
    """
    e = events.where("id IS NOT NULL AND attempt_id IS NOT NULL AND server_ts IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("attempt_id").cast("long").alias("attempt_id"), "type", F.unix_micros(F.col("server_ts").cast("timestamp")).alias("us"))
    return e.groupBy("attempt_id").transformWithState(Violations(total_at, tabs_at, flag_at), "id long, attempt_id long, n long, tabs long, action string", "append", "none")


# --- handing in


class Sittings(StatefulProcessor):
    """One attempt: its start, the last write of each answer, and its end by hand or by a timer at start + duration."""

    def __init__(self, keep: dt.timedelta):
        self.keep = int(keep.total_seconds() * 1000)  # times are microseconds since the epoch, timers milliseconds

    def init(self, handle):
        self.handle = handle
        self.span = handle.getValueState("span", "started long, deadline long, ended boolean")
        self.answers = handle.getMapState("answers", "question_id long", "saved_at long, payload string")
        self.early = handle.getListState("early", "kind string, us long, question_id long, payload string")

    def handleInputRows(self, key, rows, timerValues):
        rows = sorted(rows, key=lambda r: (r.us, r.kind != "start", r.kind == "submit", r.question_id or 0, r.payload or ""))
        started = self.span.get() if self.span.exists() else None
        if started and started[2]:
            return  # handed in: what comes now is too late
        if not started:
            start = next((r for r in rows if r.kind == "start"), None)
            if start is None:  # answers that overtook the start wait for it
                self.early.appendList([(r.kind, r.us, r.question_id, r.payload) for r in rows])
                return
            started = (start.us, start.us + 1_000_000 * start.seconds, False)
            self.span.update(started)
            self.handle.registerTimer(-(-started[1] // 1000))
            if self.early.exists():
                waited = [Row(kind=k, us=t, question_id=q, payload=p) for k, t, q, p in self.early.get()]
                rows = sorted([*waited, *rows], key=lambda r: (r.us, r.kind == "submit"))
                self.early.clear()
        for r in rows:
            if r.us > started[1] or r.us < started[0]:
                continue
            if r.kind == "answer" and r.question_id is not None:
                held = self.answers.getValue((r.question_id,)) if self.answers.containsKey((r.question_id,)) else None
                if held is None or (r.us, r.payload or "") >= (held[0], held[1] or ""):
                    self.answers.updateValue((r.question_id,), (r.us, r.payload))
            elif r.kind == "submit":
                yield self.end(key, r.us, False, started)
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        started = self.span.get() if self.span.exists() else None
        if started is None:
            return
        if started[2]:  # kept for late events long enough
            self.span.clear()
            return
        yield self.end(key, started[1], True, started)

    def end(self, key, at, auto, started):
        given = sorted((k[0], v[0], v[1]) for k, v in self.answers.iterator()) if self.answers.exists() else []
        self.answers.clear()
        if not auto:
            self.handle.deleteTimer(-(-started[1] // 1000))
        self.span.update((started[0], started[1], True))
        self.handle.registerTimer(-(-started[1] // 1000) + self.keep)
        return Row(attempt_id=key[0], us=at, auto_submitted=auto, answers=[Row(question_id=q, us=t, payload=p) for q, t, p in given])

    def close(self):
        pass


HANDED_IN = "attempt_id long, us long, auto_submitted boolean, answers array<struct<question_id:long,us:long,payload:string>>"


def sittings(events: DataFrame, late: str = "1 minute", keep: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """A stream of (attempt_id, kind, ts, seconds, question_id, payload) -> one row for each attempt that is handed in.

    Kinds: 'start' with the seconds that the exam lasts, 'answer', 'submit'. An attempt ends when it is submitted or when
    the watermark (``late`` behind the newest event) has passed start + duration; its answers are the last writes
    up to then. Events after the end are ignored, answers before their start wait for it, and the state of an
    attempt that has ended goes ``keep`` after its deadline. Output is appended.
    """
    e = events.where("attempt_id IS NOT NULL AND ts IS NOT NULL").select(F.col("attempt_id").cast("long").alias("attempt_id"), "kind", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seconds").cast("long").alias("seconds"), F.col("question_id").cast("long").alias("question_id"), F.col("payload").cast("string").alias("payload"))
    out = e.withWatermark("ts", late).groupBy("attempt_id").transformWithState(Sittings(keep), HANDED_IN, "append", "eventTime")
    answers = F.transform("answers", lambda a: F.struct(a["question_id"], F.timestamp_micros(a["us"]).alias("saved_at"), a["payload"]))
    return out.select("attempt_id", F.timestamp_micros("us").alias("submitted_at"), "auto_submitted", answers.alias("answers"))


def graded_sittings(handed_in: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers that were handed in, graded: (attempt_id, submitted_at, auto_submitted, question_id, is_correct, marks_awarded).

    ``questions``: question_id, type, key, marks, negative_marks. For a stream or a table of attempts.
    """
    a = handed_in.select("attempt_id", "submitted_at", "auto_submitted", F.explode("answers").alias("a")).select("attempt_id", "submitted_at", "auto_submitted", "a.question_id", F.col("a.payload").alias("answer_payload"))
    return grade(a.join(questions, "question_id")).select("attempt_id", "submitted_at", "auto_submitted", "question_id", "is_correct", "marks_awarded")


def sitting_scores(handed_in: DataFrame, questions: DataFrame) -> DataFrame:
    """(attempt_id, submitted_at, auto_submitted, status, score) of a batch of attempts: GRADED, or SUBMITTED where people have to grade."""
    g = graded_sittings(handed_in, questions).groupBy("attempt_id").agg(F.sum("marks_awarded").cast("decimal(18,2)").alias("score"), F.count_if(F.col("is_correct").isNull()).alias("open"))
    s = handed_in.select("attempt_id", "submitted_at", "auto_submitted").join(g, "attempt_id", "left")
    return s.select("attempt_id", "submitted_at", "auto_submitted", F.when(F.coalesce("open", F.lit(0)) > 0, "SUBMITTED").otherwise("GRADED").alias("status"), F.coalesce("score", F.lit(0).cast("decimal(18,2)")).alias("score"))


def auto_submit(events: DataFrame, questions: DataFrame, table: BucketTable, late: str = "1 minute") -> DataStreamWriter:
    """Scores of attempts as they are handed in, into ``table`` (key attempt_id); a batch that comes again changes nothing."""
    return sittings(events, late).writeStream.outputMode("append").foreachBatch(lambda batch, i: table.upsert(sitting_scores(batch, questions), i, "auto_submit") and None)


# --- figures kept up by deltas


class Contributions(StatefulProcessor):
    """What one answer adds to the figures now; a later verdict takes that back and adds its own."""

    def init(self, handle):
        self.held = handle.getValueState("held", "version long, student_id long, subject string, topic string, correct boolean, time_spent long")

    def handleInputRows(self, key, rows, timerValues):
        rows = list(rows)
        old = tuple(self.held.get()) if self.held.exists() else None
        last = max(rows, key=lambda r: (r.version, r.is_correct is not None, bool(r.is_correct), r.time_spent or 0))
        if old is not None and last.version <= old[0]:
            return
        new = (last.version, last.student_id, last.subject, last.topic, last.is_correct, last.time_spent)
        for sign, (_, student, subject, topic, correct, time) in [*([(-1, old)] if old else []), (1, new)]:
            if correct is not None:
                yield Row(question_id=key[1], student_id=student, subject=subject, topic=topic, total=sign, correct=sign * int(correct), time_spent=sign * (time or 0))
        self.held.update(new)

    def close(self):
        pass


DELTAS = "question_id long, student_id long, subject string, topic string, total long, correct long, time_spent long"
QUESTION_FIGURES = "question_id long, total long, correct long, time_spent long"
TOPIC_FIGURES = "student_id long, subject string, topic string, total long, correct long"


def answer_deltas(verdicts: DataFrame) -> DataFrame:
    """A stream of verdicts (attempt_id, question_id, student_id, subject, topic, is_correct, time_spent, version) -> signed
    changes of the figures. Of an answer's verdicts the one of the largest version counts; one that is older than what is known,
    or that comes again, changes nothing; a null verdict takes an earlier one back."""
    v = verdicts.where("attempt_id IS NOT NULL AND question_id IS NOT NULL AND version IS NOT NULL")
    v = v.select(*[F.col(c).cast("long").alias(c) for c in ("attempt_id", "question_id", "student_id", "version", "time_spent")], "subject", "topic", "is_correct")
    return v.groupBy("attempt_id", "question_id").transformWithState(Contributions(), DELTAS, "append", "none")


def keep_figures(verdicts: DataFrame, questions: BucketTable, topics: BucketTable) -> DataStreamWriter:
    """Question and topic figures, kept up in two tables by the sums of each batch's changes; only touched buckets are written."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        questions.add(batch.select("question_id", "total", "correct", "time_spent"), batch_id, "figures")
        topics.add(batch.where("subject <> '' AND topic <> ''").select("student_id", "subject", "topic", "total", "correct"), batch_id, "figures")
        batch.unpersist()

    return answer_deltas(verdicts).writeStream.outputMode("append").foreachBatch(one)


def question_figures(table: BucketTable) -> DataFrame:
    """As ``analytics.question_stats``."""
    return table.read().where("total <> 0").select("question_id", "total", "correct", (F.col("time_spent").cast("double") / F.col("total")).alias("avg_time"))


def topic_figures(table: BucketTable) -> DataFrame:
    """As ``analytics.topic_reports``."""
    return an.topic_reports(table.read().where("total <> 0"))


# --- the outbox

OUTBOX = "id long, channel string, created_at timestamp, sent_at timestamp, failed_at timestamp, attempt_count int, lease_until timestamp, lease_attempt int"


def claimed(table: BucketTable, now: Column, batch_id: int, most: int, lease: str, attempts: int) -> DataFrame:
    """The oldest unsent e-mails, claimed for a while: (id, attempt). A batch that comes again has the claims that it had."""
    due = st.due_mail(table.read(), attempts).where(F.col("lease_until").isNull() | (F.col("lease_until") <= now))
    batch = due.orderBy("created_at", "id").limit(most)
    table.upsert(batch.withColumns({"lease_until": now + F.expr(f"INTERVAL {lease}"), "lease_attempt": F.lit(batch_id)}), 2 * batch_id, "outbox")
    return table.read().where(F.col("lease_attempt") == batch_id).withColumn("attempt", F.col("attempt_count") + 1)


def dispatch_mail(ticks: DataFrame, table: BucketTable, send, most: int = 100, lease: str = "5 minutes", attempts: int = 5) -> DataStreamWriter:
    """For each batch of ticks (ts): one sweep over the outbox in ``table`` (``OUTBOX``, key id).

    Mails are claimed in the table first, then ``send`` gets them (id, attempt, ...) and returns them with sent, and
    their outcomes are written under the same batch. After a crash between sending and writing the batch comes again
    with the claims that it had, so ``send`` sees the same (id, attempt) and can tell that it was sent; the table
    has one outcome an attempt. Other dispatchers leave claimed mails alone until their lease is over.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("ts")).first()[0]
        if now is None or table.manifest()["batches"].get("outbox", -1) >= 2 * batch_id + 1:
            return
        at = F.lit(now).cast("timestamp")
        done = send(claimed(table, at, batch_id, most, lease, attempts))
        count = F.col("attempt_count") + F.when(F.col("sent"), 0).otherwise(1)
        out = done.withColumns({"sent_at": F.when(F.col("sent"), at), "failed_at": F.when(~F.col("sent") & (count >= attempts), at), "attempt_count": count.cast("int"), "lease_until": F.lit(None).cast("timestamp"), "lease_attempt": F.lit(None).cast("int")})
        table.upsert(out, 2 * batch_id + 1, "outbox")

    return ticks.writeStream.foreachBatch(one)
