"""From raw documents to training tokens: filters, deduplication, mixing and encoding, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents. Null and empty texts are documents without
words, no stage drops a document for a null in any column, repeated rows are rows of their own, and an empty
table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import mixing, repeats, similar, toxicity, unigram
from gradeloom.llm.common import cut, table
from gradeloom.llm.queries import unigram_model

#: The stages' decisions depend on a fitted model, hashes and a piece table that SQL can't express; tests/llm compares each
#: stage, and the whole run, with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. Fitted on the labels of the same tables.

    A null or empty text has no hits and stays; repeated rows share their fate.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity 0.8 or more) the document with the smallest id stays.

    SimHash fingerprints find pairs at 2 bits or less in the grid of ``op8``, which are verified exactly; the pairs that lie
    further apart are found by a prefix join.
    Texts without words form one group. Rows that repeat the smallest id all stay; a group of null ids only stays whole.
    """
    groups = similar.similar_documents(docs)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out of the text; every document stays.

    A null doc_id counts as the largest; a null text comes out empty. Rows with equal ids cut nothing from each other.
    """
    return repeats.remove_repeats(docs, output="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their source's target share and shuffled. A null source is a source of its own."""
    return mixing.poisson_mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text. A null text has no tokens, as an empty one."""
    model = unigram_model()
    return unigram.encode(docs, model, roundtrip=True, keep=["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written to the checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
