"""Callbacks of readers: signed JSON bodies, checked and turned into drafts, figures and the outcomes of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
FIGURE = f"struct<storageKey:string,boundingBox:{BOX},kind:string,caption:string>"
DRAFT = (
    "struct<position:int,text:string,detectedType:string,options:array<struct<label:string,isCorrect:boolean>>,confidence:double,sourcePageNumber:int,spanPageStart:int,spanPageEnd:int,"
    f"solutionText:string,questionSnapshotKey:string,optionCount:int,questionNumber:int,invalidCrop:boolean,sourceCoordinates:{BOX},figures:array<{FIGURE}>>"
)
BODY = f"ocrJobId long, providerUsed string, overallConfidence double, errorMessage string, drafts array<{DRAFT}>, __bad string"


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column in lower-case hex: two hashes, each behind the padded key."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(k ^ x for k in key))
    inner = F.sha2(F.concat(pad(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def checked(calls: DataFrame, jobs: DataFrame, secret: bytes) -> DataFrame:
    """Calls (call_id, body string, signature string) with what becomes of each: body read (b) and outcome.

    In this order: 'unsigned' (no signature), 'forged' (not that of the body's bytes), 'malformed' (no JSON object with
    a job and drafts or an error), 'unknown' (no such job), 'failed' (the reader reports an error), 'done' (the job is finished,
    has drafts, or an earlier call of these has finished it), else 'written'. ``jobs``: job_id, finished, drafts. Calls
    are taken in order of call_id; a null body has no signature of its own and is 'forged' or 'unsigned'.
    """
    b = F.from_json("body", BODY, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    c = calls.withColumn("b", b).join(jobs.select(F.col("job_id").alias("__job"), "finished", "drafts"), F.col("b.ocrJobId") == F.col("__job"), "left")
    unsigned = F.coalesce("signature", F.lit("")) == ""
    forged = F.coalesce(F.col("signature") != hmac_sha256(secret, F.col("body")), F.lit(True))
    malformed = F.col("b").isNull() | F.col("b.__bad").isNotNull() | F.col("b.ocrJobId").isNull() | (F.col("b.drafts").isNull() & F.col("b.errorMessage").isNull())
    failed = F.coalesce("b.errorMessage", F.lit("")) != ""
    done = F.coalesce("finished", F.lit(False)) | (F.coalesce("drafts", F.lit(0)) > 0)
    c = c.withColumn("outcome", F.when(unsigned, "unsigned").when(forged, "forged").when(malformed, "malformed").when(F.col("__job").isNull(), "unknown").when(failed, "failed").when(done, "done").otherwise("written"))
    # of a job's calls that could be written the first one is; an aggregation, so a job that is called very often is no window
    first = c.where("outcome = 'written'").groupBy("__job").agg(F.min("call_id").alias("__first"))
    c = c.join(first, "__job", "left")
    again = (F.col("outcome") == "written") & (F.col("call_id") != F.col("__first"))
    return c.select("call_id", F.col("__job").alias("job_id"), "signature", F.when(again, "done").otherwise(F.col("outcome")).alias("outcome"), "b")


def refused(calls: DataFrame) -> DataFrame:
    """(call_id, outcome) of calls that were turned away."""
    return calls.where(F.col("outcome").isin("unsigned", "forged", "malformed", "unknown")).select("call_id", "outcome")


def drafts_of_calls(calls: DataFrame) -> DataFrame:
    """The drafts of written calls, one a row, with defaults for what a reader leaves out and the number of figures."""
    d = calls.where("outcome = 'written'").select("job_id", F.explode("b.drafts").alias("d"))
    options = F.transform("d.options", lambda o: F.struct(o["label"].alias("label"), F.coalesce(o["isCorrect"], F.lit(False)).alias("is_correct")))
    return d.select(
        "job_id", "d.position", "d.text", F.col("d.detectedType").alias("detected_type"), options.alias("options"), "d.confidence", F.col("d.sourcePageNumber").alias("source_page_number"), F.col("d.spanPageStart").alias("span_page_start"),
        F.col("d.spanPageEnd").alias("span_page_end"), F.col("d.solutionText").alias("solution_text"), F.col("d.questionSnapshotKey").alias("question_snapshot_key"), F.col("d.optionCount").alias("option_count"),
        F.col("d.questionNumber").alias("question_number"), F.col("d.invalidCrop").alias("invalid_crop"), F.col("d.sourceCoordinates").alias("source_coordinates"), F.coalesce(F.size("d.figures"), F.lit(0)).alias("figures"),
    )


def figures_of_calls(calls: DataFrame) -> DataFrame:
    """(job_id, position, figure_index, storage_key, kind, caption, box) of written calls."""
    d = calls.where("outcome = 'written'").select("job_id", F.explode("b.drafts").alias("d")).select("job_id", "d.position", F.posexplode("d.figures").alias("figure_index", "f"))
    return d.select("job_id", "position", "figure_index", F.col("f.storageKey").alias("storage_key"), "f.kind", "f.caption", F.col("f.boundingBox").alias("box"))


def job_outcomes(calls: DataFrame) -> DataFrame:
    """(job_id, stage, status, error, drafts, confidence) that the last call of each job leaves; jobs whose calls change nothing are not there.

    A written call completes a job and its upload is ready for review; a failed one leaves the reader's message.
    """
    c = calls.where("outcome IN ('written', 'failed')")
    last = c.groupBy("job_id").agg(F.max_by(F.struct("outcome", "b"), F.col("call_id")).alias("r"))
    written = F.col("r.outcome") == "written"
    return last.select(
        "job_id", F.when(written, "COMPLETED").otherwise("FAILED").alias("stage"), F.when(written, "READY_FOR_REVIEW").otherwise("FAILED").alias("status"), F.when(~written, F.col("r.b.errorMessage")).alias("error"),
        F.when(written, F.size("r.b.drafts")).otherwise(0).alias("drafts"), F.when(written, F.col("r.b.overallConfidence")).alias("confidence"),
    )
