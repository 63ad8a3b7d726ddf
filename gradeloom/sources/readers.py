"""Files of the platform as DataFrames, and tables that are added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.authoring import appended_rows, upserted_rows
from gradeloom.operators.routing import read_log

CALLBACK = "job_id string, status string, confidence double, drafts array<struct<position:int,text:string,options:array<string>>>"
# Kinds of files by the end of their names.
KINDS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def answer_key_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each text file as a whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def routing_logs(spark: SparkSession, path: str) -> DataFrame:
    """Routing records of log files; other and malformed lines are left out."""
    return read_log(spark.read.text(path).withColumnRenamed("value", "line"))


def callbacks(spark: SparkSession, path: str) -> DataFrame:
    """Drafts that readers have sent, one JSON object a line; rows without a job are left out."""
    return spark.read.schema(CALLBACK).json(path).where("job_id IS NOT NULL")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(storage_key, mime, bytes) of files; the kind is told by the name."""
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(*[F.when(end == k, F.lit(v)) for k, v in KINDS.items()], F.lit("application/octet-stream"))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("storage_key"), mime.alias("mime"), F.col("content").alias("bytes"))


def append_new(spark: SparkSession, path: str, to: str, new: DataFrame, *unique: str) -> None:
    """Write the table at ``path`` with new rows added to the folder ``to``; rows whose key it has are left out."""
    appended_rows(spark.read.parquet(path), new, *unique).write.mode("overwrite").parquet(to)


def upsert(spark: SparkSession, path: str, to: str, new: DataFrame, *unique: str) -> None:
    """Write the table at ``path`` with new rows in place of those of the same key to the folder ``to``."""
    upserted_rows(spark.read.parquet(path), new, *unique).write.mode("overwrite").parquet(to)
