"""Ranked lexical search: each shard of documents has a tiered index, high-impact postings first.

A posting's impact is what it adds to a score. A shard's postings lie in ``len(TIERS) + 1`` tiers of falling
impact, and each tier knows, term by term, the largest impact below it (the residual bound). A query adds up
the first tier; the residuals then bound what any document of the shard can still reach. Where that proves
that no document reaches the query's threshold the shard is done with; else the query falls through to the
next tier, and the last one leaves nothing open. The threshold is the k-th best sum that the first tiers of
all shards give, so it never exceeds the k-th best score. No posting list is cut: results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Shipped, cut

#: What a byte becomes: A-Z lower-cased, other ASCII signs than letters and digits a space.
TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: A shard ends at so many documents or postings, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Shares of a shard's postings in all tiers but the last.
TIERS = (0.2, 0.3)
#: Terms of queries that are searched at once, and the largest vocabulary of queries that documents are read against;
#: beyond it all terms are indexed. More queries go through in blocks.
BLOCK_TERMS, MOST_VOCABULARY = 1_000_000, 1_000_000
K = 20


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TO_TERMS).split() if text else []


class Shard:
    """Postings of a run of documents, gathered one document at a time."""

    def __init__(self, vocabulary: frozenset | None, most_docs: int = SHARD_DOCS, most_postings: int = SHARD_POSTINGS):
        self.vocabulary, self.most_docs, self.most_postings = vocabulary, most_docs, most_postings
        self.clear()

    def clear(self):
        self.ids, self.lengths, self.lists, self.held, self.without = [], [], {}, 0, 0

    def add(self, doc_id: int | None, text: bytes | None):
        words = terms(text)
        if not words:
            self.without += 1
            return
        counts = Counter(words)
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        for t in counts if self.vocabulary is None else counts.keys() & self.vocabulary:
            self.lists.setdefault(t, []).append((at, counts[t]))
            self.held += 1

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or self.held >= self.most_postings

    def row(self) -> pa.RecordBatch:
        found = sorted(self.lists)
        flat = np.array([p for t in found for p in self.lists[t]], np.int64).reshape(-1, 2)
        sizes = [len(self.lists[t]) for t in found]
        columns = [
            pa.array([self.ids], pa.list_(pa.int64())),
            pa.array([self.lengths], pa.list_(pa.int64())),
            pa.array([found], pa.list_(pa.binary())),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([flat[:, 0].astype(np.int32).tobytes()], pa.binary()),
            pa.array([flat[:, 1].astype(np.int32).tobytes()], pa.binary()),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "df", "docs", "tf"])


POSTINGS = "ids array<long>, lengths array<long>, terms array<binary>, df array<long>, docs binary, tf binary"


def postings(docs: DataFrame, vocabulary: Shipped | None, most_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a shard: ids and lengths of its documents with terms, and its terms' posting lists one after the other.

    Documents stay in the partition that they are read in, so no text is shuffled.
    """

    def run(batches):
        shard = Shard(None if vocabulary is None else vocabulary.get(), most_docs)
        for b in batches:
            for i, text in enumerate(b.column("text")):
                shard.add(b.column("doc_id")[i].as_py(), text.as_py())
                if shard.full():
                    yield shard.row()
        if shard.ids:
            yield shard.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, POSTINGS)


class Tiers:
    """The tiers of one shard: per tier and term, documents and impacts, and the largest impact below the tier."""

    def __init__(self, row: dict, weights: dict[bytes, int], n_docs: int, n_terms: int, shares: tuple = TIERS):
        self.ids = row["ids"]
        m = 75 + (25 * np.array(row["lengths"], np.int64) * n_docs) // n_terms
        docs, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        sizes = np.array(row["df"], np.int64)
        w = np.array([weights.get(t, 0) for t in row["terms"]], np.int64)
        term = np.repeat(np.arange(len(sizes)), sizes)
        impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        tier = np.full(len(impact), len(shares))
        if len(impact):
            order, at = np.sort(impact), len(impact)
            for i, share in enumerate(shares):
                at -= int(share * len(impact))
                tier[(tier == len(shares)) & (impact >= order[min(at, len(order) - 1)])] = i
        self.number = {t: i for i, t in enumerate(row["terms"]) if w[i] > 0}
        self.tiers, self.below = [], []
        for i in range(len(shares) + 1):
            here = np.flatnonzero(tier == i)
            starts = np.searchsorted(term[here], np.arange(len(sizes) + 1)).tolist()
            self.tiers.append((starts, docs[here], impact[here]))
            rest = np.zeros(len(sizes), np.int64)
            np.maximum.at(rest, term[tier > i], impact[tier > i])
            self.below.append(rest)

    def known(self, query: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
        return [(self.number[t], times) for t, times in query if t in self.number]

    def add_tier(self, i: int, known: list[tuple[int, int]], scores: np.ndarray) -> int:
        """Add a tier's impacts to ``scores``; returns how much a document can gain below it at most."""
        starts, docs, impact = self.tiers[i]
        for t, times in known:
            a, b = starts[t], starts[t + 1]
            if a < b:
                scores[docs[a:b]] += times * impact[a:b]  # a document stands once in a term's list
        return sum(times * int(self.below[i][t]) for t, times in known)


class Queries:
    """A block of queries, what their terms weigh, and sums over all documents."""

    def __init__(self, items: list, *sums):
        self.items, self.sums = items, sums

    def tiers(self, batch):
        for row in batch.to_pylist():
            yield Tiers(row, *self.sums)


def first_sums(index: DataFrame, box: Shipped, k: int) -> DataFrame:
    """(item int, least long): the k-th best sum of the first tier over all shards, where there are so many."""

    def run(batches):
        q = box.get()
        best: list[list[int]] = [[] for _ in q.items]
        for b in batches:
            for shard in q.tiers(b):
                scores = np.zeros(len(shard.ids), np.int64)
                for i, (_, query) in enumerate(q.items):
                    if known := shard.known(query):
                        scores[:] = 0
                        shard.add_tier(0, known, scores)
                        top = np.partition(scores, -k)[-k:] if len(scores) > k else scores
                        best[i] = heapq.nlargest(k, best[i] + top[top > 0].tolist())
        rows = [(i, s) for i, sums in enumerate(best) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["item", "score"])

    sums = best_rows(index.mapInArrow(run, "item int, score long"), ["item"], [F.desc("score")], k)
    return sums.where(F.col("rank") == k).select("item", F.col("score").alias("least"))


def tiered_search(index: DataFrame, box: Shipped, least: Shipped, k: int) -> DataFrame:
    """(item int, doc_id long, score long): each task's k best of every query that reach the query's threshold."""

    def run(batches):
        q, reach = box.get(), least.get()
        best: list[list[tuple]] = [[] for _ in q.items]
        for b in batches:
            for shard in q.tiers(b):
                scores = np.zeros(len(shard.ids), np.int64)
                for i, (_, query) in enumerate(q.items):
                    known = shard.known(query)
                    if not known:
                        continue
                    scores[:] = 0
                    bar = max(reach.get(i, 1), -best[i][-1][0] if len(best[i]) == k else 1)
                    for tier in range(len(shard.tiers)):
                        left = shard.add_tier(tier, known, scores)
                        if int(scores.max()) + left < bar:
                            break  # proven: no document of this shard is among the best
                        if left == 0:
                            at = np.flatnonzero(scores >= bar)
                            found = [(-int(scores[j]), shard.ids[j] is None, shard.ids[j] or 0) for j in at]
                            best[i] = heapq.nsmallest(k, best[i] + found)
                            break
        rows = [(i, None if null else d, -s) for i, found in enumerate(best) for s, null, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def best_rows(df: DataFrame, keys: list[str], order: list, k: int, groups: int = 64) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``, in two steps, so that no task reads all rows of a key."""
    part = Window.partitionBy(*keys, "__part").orderBy(*order)
    few = df.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(groups))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("__part", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def items_of(items: DataFrame) -> DataFrame:
    """(item_id long, terms array<binary>, times array<int>) of every different (item_id, text) that has terms."""

    def run(batches):
        for b in batches:
            counts = [Counter(terms(t.as_py())) for t in b.column("text")]
            found = [sorted(c) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary())), pa.array([[c[t] for t in f] for c, f in zip(counts, found)], pa.list_(pa.int32()))], ["item_id", "terms", "times"])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    return plain.mapInArrow(run, "item_id long, terms array<binary>, times array<int>").where(F.size("terms") > 0)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = K, tiers: tuple = TIERS, shard_docs: int = SHARD_DOCS, block_terms: int = BLOCK_TERMS, most_vocabulary: int = MOST_VOCABULARY) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, null ids last. Rows of documents are documents of their own, also where
    ids repeat; a repeated (item_id, text) is one item, and an item_id with two texts has two lists. Null and
    empty texts have no terms: such documents are never found, such items have no rows, and neither has an
    item all of whose terms are unknown (or weigh nothing). Empty tables give an empty result; other columns
    are not looked at. Queries are broadcast in blocks of about ``block_terms`` terms; the other parameters change
    the index and the work, never the rows.
    """
    spark = docs.sparkSession
    queries = cut(items_of(items))
    held = queries.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    vocabulary = None
    if held <= most_vocabulary:
        vocabulary = Shipped(spark, frozenset(bytes(r["t"]) for r in queries.select(F.explode("terms").alias("t")).distinct().collect()))
    index = cut(postings(docs, vocabulary, shard_docs))
    sizes = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = sizes["n"] or 0, sizes["l"] or 0
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = max(1, math.ceil(held / block_terms))
    for block in range(blocks if n_terms else 0):
        part = queries.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block)
        rows = [(r["item_id"], list(zip(map(bytes, r["terms"]), r["times"]))) for r in part.collect()]
        wanted = part.select(F.explode("terms").alias("term")).distinct()
        df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
        df = df.groupBy("term").agg(F.sum("df").alias("df")).join(wanted, "term", "left_semi")
        box = Shipped(spark, Queries(rows, {bytes(r["term"]): weight(n_docs, r["df"]) for r in df.collect()}, n_docs, n_terms, tiers))
        least = Shipped(spark, {r["item"]: r["least"] for r in first_sums(index, box, k).collect()})
        best = best_rows(tiered_search(index, box, least, k), ["item"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], "item int, item_id long")
        found = found.union(best.join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return found


#: DuckDB's twin of ``op11``.
SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
q AS (
  SELECT item_id, text, term, count(*) AS times
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, text, term),
x AS (
  SELECT q.item_id, q.text, p.r, any_value(p.doc_id) AS doc_id,
         CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, q.text, p.r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) <= 20
"""
