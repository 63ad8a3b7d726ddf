"""Streams against the same rules in batch, and readers."""

import datetime as dt

from gradeloom.sources import readers
from gradeloom.streaming import jobs
from gradeloom.streaming.ticks import tick_dedupe

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, name):
    q = writer.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_answer_states(spark, tmp_path):
    rows = [(i % 4, i % 3, T0 + dt.timedelta(seconds=i), i if i % 5 else None, bool(i % 2) if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "attempt_id int, question_id int, saved_at timestamp, time_spent int, is_correct boolean")
    run(jobs.answer_states(stream_of(spark, df, str(tmp_path / "a"))).writeStream.outputMode("complete"), "answer_states")
    assert sorted(spark.table("answer_states").collect()) == sorted(jobs.answer_states(df).collect())


def test_requests_and_ticks(spark, tmp_path):
    rows = [("u", T0 + dt.timedelta(seconds=s)) for s in (1, 2, 3, 15, 16, 31, 400)]
    df = spark.createDataFrame(rows, "user string, ts timestamp")
    run(jobs.requests_over(stream_of(spark, df, str(tmp_path / "r"), 1), "user", most=2).writeStream.outputMode("append"), "over")
    assert {(r.start.second, r.n, r.over) for r in spark.table("over").collect() if r.start.minute == 0} == {(0, 3, 1), (10, 2, 0), (30, 1, 0)}
    run(tick_dedupe(stream_of(spark, df.select("ts"), str(tmp_path / "t"), 1)).writeStream.outputMode("append"), "ticks")
    assert len(spark.table("ticks").collect()) == 3  # 0, 30 and 390 s


def test_readers(spark, tmp_path):
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "a.txt").write_text("1-A\n2-B")
    assert [r.text for r in readers.answer_key_files(spark, str(tmp_path / "keys")).collect()] == ["1-A\n2-B"]
    (tmp_path / "log.txt").write_text('x [ocr-routing] {"storageKey": "k", "wouldRoute": true, "score": 0.9}\nother\n[ocr-routing] {bad\n[ocr-routing] {"storageKey": "m"}\n')
    assert sorted((r.storageKey, r.wouldRoute, r.score) for r in readers.routing_logs(spark, str(tmp_path / "log.txt")).collect()) == [("k", True, 0.9), ("m", False, 0.0)]
    (tmp_path / "calls.json").write_text('{"job_id": "j1", "drafts": [{"position": 0, "text": "q"}]}\n{"status": "x"}\n')
    assert [(r.job_id, r.drafts[0].text) for r in readers.callbacks(spark, str(tmp_path / "calls.json")).collect()] == [("j1", "q")]
    (tmp_path / "f.PDF").write_bytes(b"%PDF")
    assert [(r.mime, bytes(r.bytes)) for r in readers.stored_files(spark, str(tmp_path / "f.PDF")).collect()] == [("application/pdf", b"%PDF")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id int, v string")
    old.write.parquet(str(tmp_path / "t0"))
    readers.append_new(spark, str(tmp_path / "t0"), str(tmp_path / "t1"), new, "id")
    readers.upsert(spark, str(tmp_path / "t0"), str(tmp_path / "t2"), new.distinct(), "id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t1")).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t2")).collect())) == [(1, "a"), (2, "x"), (3, "c")]
