"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import os
from functools import cache

from pyspark.sql import functions as F

from gradeloom.llm import blocks, chat, collocations, hnsw, mixing, pstable, quality, ranking, repeats, revisits, simhash, toxicity, unigram
from gradeloom.llm.common import table

#: The piece table; a path on the driver, from where the pieces are broadcast.
PIECES = os.environ.get("GRADELOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@cache
def unigram_model(path: str = PIECES) -> unigram.Unigram:
    return unigram.Unigram.from_file(path)


LLM_QUERIES = {}
LLM_SQL = {}


def llm_query(name, sql=None):
    def put(f):
        LLM_QUERIES[name] = f
        if sql is not None:
            LLM_SQL[name] = sql
        return f

    return put


@llm_query("op1_poisson_mix", mixing.MIX_SQL)
def op1(spark, sf_dir):
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


@llm_query("op2_warc_revisits", revisits.REVISIT_SQL)
def op2(spark, sf_dir):
    r = revisits.resolve_revisits(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return r.select("record_id", "page_id", "canonical", "outcome", "refers_to", flat.alias("merged_headers"), "merged_digest")


@llm_query("op4_hnsw_nearest")
def op4(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(v, v.where("vec_id % 100 = 0"))


@llm_query("op5_pstable_links", pstable.LINK_SQL)
def op5(spark, sf_dir):
    return pstable.vector_links(table(spark, sf_dir, "embeddings"))


@llm_query("op8_simhash")
def op8(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@llm_query("op6_block_labeller")
def op6(spark, sf_dir):
    return blocks.extract(table(spark, sf_dir, "pages"))


@llm_query("op7_unigram_tokens")
def op7(spark, sf_dir):
    return unigram.encode(table(spark, sf_dir, "documents"), unigram_model(), digests=True)


@llm_query("op9_chat_turns")
def op9(spark, sf_dir):
    t = chat.transcripts_of(table(spark, sf_dir, "conversations"))
    turns = chat.parse(t, chat.fit(t.where(~chat.held_out(F.col("conv_id")))))
    return turns.select("conv_id", chat.held_out(F.col("conv_id")).alias("held_out"), "turn", "role", F.length("text").cast("long").alias("n_chars"), F.md5("rendered").alias("rendered_md5"))


@llm_query("op10_toxicity")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@llm_query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@llm_query("op11_tiered_search", ranking.SEARCH_SQL)
def op11(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@llm_query("op12_collocations", collocations.COLLOCATION_SQL)
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@llm_query("op13_quality")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
