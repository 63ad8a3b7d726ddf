"""Streams with state of their own against plain replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.grading import grade
from gradeloom.operators import analytics as an
from gradeloom.operators import state as st
from gradeloom.sources.buckets import BucketTable
from gradeloom.streaming import stateful as sf

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    sf.state_store(spark)


class Feed:
    """A stream that is fed batch by batch; every run takes what is new and goes on from its checkpoint."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path, schema, 0
        (tmp_path / "in").mkdir()
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def put(self, rows):
        self.n += 1
        part = f"{self.path}/part{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(part)
        import glob
        import os
        import time

        f = glob.glob(f"{part}/*.parquet")[0]
        os.rename(f, f"{self.path}/in/{self.n:04}.parquet")
        os.utime(f"{self.path}/in/{self.n:04}.parquet", (time.time() + self.n,) * 2)

    def run(self, writer):
        q = writer.option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True).start()
        q.awaitTermination(180)
        if q.exception():
            raise q.exception()


def collected(into):
    return lambda df, i: into.extend(df.collect())


VIOLATION = "id long, attempt_id long, type string, server_ts timestamp"


def test_violations_equal_the_batch_replay(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.randint(1, 5), r.choice(["TAB_SWITCH", "COPY", "BLUR"]), T0 + dt.timedelta(seconds=i)) for i in range(70)] + [(100 + i, 9, "TAB_SWITCH", T0 + dt.timedelta(seconds=200 + i)) for i in range(2)]
    want = sorted(map(tuple, st.violation_states(spark.createDataFrame(rows, VIOLATION)).collect()))
    feed, got, at = Feed(spark, tmp_path, VIOLATION), [], 0
    while at < len(rows):
        n = r.randint(1, 30)
        feed.put(rows[at : at + n] + rows[max(0, at - 3) : at] + [(None, 1, "COPY", T0)])  # the last ones come again
        at += n
        feed.run(sf.violation_stream(feed.stream).writeStream.outputMode("append").foreachBatch(collected(got)))  # a restart each time
    assert sorted(map(tuple, got)) == want
    assert {x[4] for x in want} >= {"NONE", "AUTO_SUBMIT"}


EVENT = "attempt_id long, kind string, ts timestamp, seconds long, question_id long, payload string"
QUESTIONS = [(1, "TRUE_FALSE", '{"correct": true}', 2.0, 1.0), (2, "SINGLE_CHOICE", '{"correct": ["b"]}', 3.0, 0.0), (3, "DESCRIPTIVE", "{}", 5.0, 0.0)]


def test_attempts_are_handed_in_by_timers_and_graded(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    yes, no, b = '{"answer": true}', '{"answer": false}', '{"selectedOptionId": "b"}'
    feed, got = Feed(spark, tmp_path, EVENT), []
    run = lambda: feed.run(sf.sittings(feed.stream, "30 seconds").writeStream.outputMode("append").foreachBatch(collected(got)))
    feed.put([(1, "start", at(0), 100, None, None), (1, "answer", at(10), None, 1, no), (2, "start", at(0), 100, None, None), (2, "answer", at(5), None, 2, b), (4, "answer", at(1), None, 1, yes)])
    feed.put([(1, "answer", at(20), None, 1, yes), (2, "submit", at(50), None, None, None), (2, "answer", at(60), None, 2, "late"), (4, "start", at(0), 100, None, None), (3, "start", at(90), 1000, None, None)])
    run()
    assert [(r.attempt_id, r.auto_submitted, r.submitted_at) for r in got] == [(2, False, at(50))]
    # the watermark is at 90 - 30 s; an answer of second 70 comes late and still counts, one after the end does not
    feed.put([(1, "answer", at(70), None, 2, b), (1, "answer", at(101), None, 1, no), (1, "answer", at(15), None, 1, no)])
    run()  # restarted from its checkpoint
    assert len(got) == 1
    feed.put([(3, "answer", at(200), None, 3, '{"text": "essay"}')])
    feed.put([(9, "start", at(201), 10, None, None)])
    run()
    assert sorted((r.attempt_id, r.auto_submitted, r.submitted_at, [(a.question_id, a.payload) for a in r.answers]) for r in got) == [
        (1, True, at(100), [(1, yes), (2, b)]), (2, False, at(50), [(2, b)]), (4, True, at(100), [(1, yes)])]
    feed.put([(1, "answer", at(300), None, 1, no), (2, "submit", at(300), None, None, None), (3, "submit", at(400), None, None, None)])
    run()
    assert sorted(r.attempt_id for r in got) == [1, 2, 3, 4, 9]
    q = spark.createDataFrame(QUESTIONS, "question_id long, type string, key string, marks double, negative_marks double")
    handed = spark.createDataFrame([tuple(r) for r in got], "attempt_id long, submitted_at timestamp, auto_submitted boolean, answers array<struct<question_id:long,saved_at:timestamp,payload:string>>")
    scores = {r.attempt_id: (r.status, float(r.score)) for r in sf.sitting_scores(handed, q).collect()}
    assert scores == {1: ("GRADED", 5.0), 2: ("GRADED", 3.0), 3: ("SUBMITTED", 0.0), 4: ("GRADED", 2.0), 9: ("GRADED", 0.0)}
    assert sf.graded_sittings(handed, q).count() == 5 and grade is not None


def test_auto_submit_writes_scores_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENT)
    table = BucketTable(spark, str(tmp_path / "scores"), ["attempt_id"], "attempt_id long, submitted_at timestamp, auto_submitted boolean, status string, score decimal(18,2)", 4)
    q = spark.createDataFrame(QUESTIONS, "question_id long, type string, key string, marks double, negative_marks double")
    feed.put([(1, "start", T0, 100, None, None), (1, "answer", T0, None, 1, '{"answer": false}'), (1, "submit", T0 + dt.timedelta(seconds=1), None, None, None)])
    feed.run(sf.auto_submit(feed.stream, q, table))
    assert [(r.attempt_id, r.status, float(r.score)) for r in table.read().collect()] == [(1, "GRADED", -1.0)]


VERDICT = "attempt_id long, question_id long, student_id long, subject string, topic string, is_correct boolean, time_spent long, version long"


def test_figures_by_deltas_equal_recomputation(spark, tmp_path):
    r = random.Random(8)
    feed = Feed(spark, tmp_path, VERDICT)
    questions = BucketTable(spark, str(tmp_path / "q"), ["question_id"], sf.QUESTION_FIGURES, 8)
    topics = BucketTable(spark, str(tmp_path / "t"), ["student_id", "subject", "topic"], sf.TOPIC_FIGURES, 8)
    known, version = {}, 0
    for _ in range(3):
        batch = []
        for _ in range(40):
            version += 1
            a, q = r.randint(1, 12), r.randint(1, 9)
            row = (a, q, a % 5, ["phy", "mat", ""][q % 3], f"t{q % 4}", r.choice([True, False, None]), r.randint(1, 50), version)
            batch.append(row)
            known[a, q] = row  # regraded answers take their earlier verdict back
        feed.put(batch + batch[:5])
        feed.run(sf.keep_figures(feed.stream, questions, topics))
    now = spark.createDataFrame(list(known.values()), VERDICT)
    assert sorted(sf.question_figures(questions).collect()) == sorted(an.question_stats(now).collect())
    attempts = now.select(F.col("attempt_id").alias("id"), "student_id").distinct()
    names = now.select(F.col("question_id").alias("id"), "subject", "topic").distinct()
    assert sorted(sf.topic_figures(topics).collect()) == sorted(an.topic_reports(an.topic_counts(now, attempts, names)).collect())


def test_bucket_table_rewrites_touched_buckets_once(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "b"), ["id"], "id long, v string", 16)
    assert t.read().count() == 0
    first = t.upsert(spark.range(2000).select("id", F.repeat(F.lit("x"), 20).alias("v")), 0)
    assert first["touched"] == 16
    new = spark.createDataFrame([(5, "a"), (5, "b"), (4000, "c")], "id long, v string")
    change = t.upsert(new, 1)
    assert 1 <= change["touched"] <= 2 and change["bytes"] < first["bytes"] / 4
    assert t.upsert(new.withColumn("v", F.lit("again")), 1) == {"touched": 0, "bytes": 0}  # the batch comes again
    got = {r.id: r.v for r in t.read().collect()}
    assert len(got) == 2001 and got[5] == "b" and got[4000] == "c" and got[6] == "x" * 20
    assert {r.id: r.v for r in t.read(version=0).collect()}[5] == "x" * 20  # earlier versions can be read
    assert t.upsert(new.limit(0), 2)["touched"] == 0 and t.manifest()["batches"] == {"": 2}
    # a writer that was overtaken has an error and the table stays as it is
    version = t.version()
    with pytest.raises(RuntimeError):
        t._commit(version, {"buckets": {}})
    counts = BucketTable(spark, str(tmp_path / "c"), ["k"], "k string, n long", 4)
    counts.add(spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n long"), 0, "w")
    counts.add(spark.createDataFrame([("b", -5), ("c", 1)], "k string, n long"), 1, "w")
    assert sorted(map(tuple, counts.read().collect())) == [("a", 3), ("c", 1)]


def test_mails_have_one_outcome_an_attempt(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "outbox"), ["id"], sf.OUTBOX, 4)
    rows = [(i, "EMAIL" if i != 3 else "IN_APP", T0 + dt.timedelta(seconds=i), None, None, 4 if i == 2 else 0, None, None) for i in range(6)]
    table.upsert(spark.createDataFrame(rows, sf.OUTBOX))
    feed, sent, crash = Feed(spark, tmp_path, "ts timestamp"), [], [True]

    def send(mails):
        for m in mails.collect():
            sent.append((m.id, m.attempt))  # the mail server knows (id, attempt)
        if crash[0]:
            crash[0] = False
            raise OSError("the dispatcher dies after sending")
        return mails.withColumn("sent", ~F.col("id").isin(1, 2))

    run = lambda: feed.run(sf.dispatch_mail(feed.stream, table, send, most=4))
    feed.put([(T0 + dt.timedelta(hours=1),)])
    with pytest.raises(Exception):  # noqa: B017
        run()
    assert table.read().where("lease_attempt IS NOT NULL").count() == 4 and table.read().where("sent_at IS NOT NULL").count() == 0
    other = sf.claimed(table, F.lit(T0 + dt.timedelta(hours=1, minutes=1)), 50, 10, "5 minutes", 5)
    assert [r.id for r in other.collect()] == [5]  # another dispatcher leaves claimed mails alone
    table.upsert(table.read().where("id = 5").withColumns({"lease_until": F.lit(None).cast("timestamp"), "lease_attempt": F.lit(None).cast("int")}))
    manifest = table.manifest()
    table._commit(table.version() + 1, manifest | {"batches": {"outbox": 0}})
    run()  # the batch comes again with the same claims
    assert sorted(sent[:4]) == sorted(sent[4:8]) == [(0, 1), (1, 1), (2, 5), (4, 1)]
    state = {r.id: (r.sent_at is not None, r.failed_at is not None, r.attempt_count, r.lease_attempt) for r in table.read().collect()}
    assert state == {0: (True, False, 0, None), 1: (False, False, 1, None), 2: (False, True, 5, None), 3: (False, False, 0, None), 4: (True, False, 0, None), 5: (False, False, 0, None)}
    feed.put([(T0 + dt.timedelta(hours=2),)])
    run()
    assert sorted(sent[8:]) == [(1, 2), (5, 1)] and len(set(sent)) == 6
