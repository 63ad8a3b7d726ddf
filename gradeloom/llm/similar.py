"""Near-duplicates by SimHash, verified by the exact Jaccard similarity of word shingles; a prefix join finds the links that
fingerprints are too far apart for, so that none is lost at any threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Shipped, cut, fitted, partitions
from gradeloom.llm.components import components
from gradeloom.llm.simhash import SEGMENTS, majority, near_fingerprints

SEED = 42
#: Texts (in expectation) that tell which shingles are common, and most of those. They only set the order in
#: which shingles are looked at: any order finds every pair, a good one finds few others.
SAMPLED, MOST_COMMON = 5_000, 50_000


#: Whole texts that are worth a task, by number and by bytes.
TEXTS_A_TASK, BYTES_A_TASK = 2_000, 8_000_000

#: Ids that a join broadcasts, at most (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted; a shorter text is one shingle, one without words has none."""
    words = words_of(text)
    k = max(1, len(words) - width + 1) if words else 0
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(k)), np.uint64, k)
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def parity_bits(h: np.ndarray) -> bytes:
    """How often each remainder of the hashes occurs, even or odd: two to four bits a shingle.

    Two sets' bits differ in no more places than their elements do, however they are folded.
    """
    size = max(64, 1 << max(0, 2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_reach(a: bytes, n_a: int, b: bytes, n_b: int, similarity: float) -> bool:
    """Whether two sets can have this Jaccard similarity by their parity bits and sizes. Never false for sets that have it."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return (n_a + n_b - apart) / 2 >= similarity / (1 + similarity) * (n_a + n_b) - 1e-6


def _classes(width):
    """Texts with the same words are one class; its key is a 64-bit hash of the words. With the shingles' number, parity bits and SimHash."""

    def run(batches):
        for b in batches:
            keys, bits, ns, fps = [], [], [], []
            for t in b.column("text"):
                t = t.as_py()
                h = shingles(t, width)
                keys.append(xxhash.xxh3_64_intdigest(b" ".join(words_of(t)), SEED))
                bits.append(parity_bits(h))
                ns.append(len(h))
                fps.append(majority(h))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(ns, pa.int32()), pa.array(fps, pa.int64())], ["doc_id", "text", "cls", "bits", "n", "fp"])
        pa.default_memory_pool().release_unused()

    return run


def _keys(batches):
    for b in batches:
        keys = [xxhash.xxh3_64_intdigest(b" ".join(words_of(t.as_py())), SEED) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(keys, np.uint64).view(np.int64))], ["doc_id", "cls"])


def _possible(similarity):
    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")]
            yield b.select(["a", "b"]).filter(pa.array([may_reach(*row, similarity) for row in zip(*cols)], pa.bool_()))

    return run


def _all_shingles(width):
    def run(batches):
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), width).view(np.int64))], ["h"])

    return run


def _prefixes(width, similarity, box):
    """The first n - ceil(similarity * n) + 1 of a text's n shingles in a common order, uncommon ones first.

    Texts at the similarity share ceil(similarity * n) shingles at least, so one of the first of both.
    """

    def run(batches):
        common, counts = box.get()
        for b in batches:
            hs, cs, ns, places = [], [], [], []
            for c, t in zip(b.column("cls").to_pylist(), b.column("text")):
                h = shingles(t.as_py(), width)
                n = len(h)
                if not n:
                    continue
                weight = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    weight = np.where(common[at] == h, counts[at], 0)
                first = h[np.lexsort((h, weight))[: n - math.ceil(similarity * n - 1e-9) + 1]]
                hs.append(first)
                cs.append(np.full(len(first), c, np.int64))
                ns.append(np.full(len(first), n, np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(places))], ["h", "cls", "n", "pos"])
        pa.default_memory_pool().release_unused()

    return run


def _shared(batches):
    """Of rows sorted by h those whose shingle has another row, each with one of them as hub (the middle one by size)."""
    names, kept = ["h", "cls", "n", "pos"], None

    def out(h, c, n, pos):
        if not len(h):
            return None
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((first, [len(h)])))
        hub = np.repeat(first + size // 2, size)
        many = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (h, c, n, pos, c[hub], n[hub])], [*names, "hub", "hub_n"])

    for b in batches:
        cols = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        whole = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0  # the last shingle may go on in the next batch
        kept = [x[whole:] for x in cols]
        if (r := out(*[x[:whole] for x in cols])) is not None:
            yield r
    if kept is not None and (r := out(*kept)) is not None:
        yield r


def _verify(width, similarity):
    def run(batches):
        for b in batches:
            ok = [jaccard(shingles(x.as_py(), width), shingles(y.as_py(), width)) >= similarity - 1e-9 for x, y in zip(b.column("ta"), b.column("tb"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        pa.default_memory_pool().release_unused()  # texts of the batches; the worker lives on

    return run


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text; other columns are not used).

    Documents link when the Jaccard similarity of their sets of ``shingle``-word shingles (ASCII letters
    lower-cased, words split at white space) is ``similarity`` or more; component_id is the smallest doc_id
    that links reach. SimHash goes first: texts whose fingerprints (of the same shingles) differ in 2 bits or less
    are verified on the whole texts, in one round with each text against two hubs of each of its shingles. Fingerprints
    of texts at the similarity may differ in more bits, so a prefix join follows that loses no link: two such texts share
    one of the first shingles of each, and every pair of different groups that meets there is verified, unless parity
    bits of the two sets rule it out. Pairs that the first round has joined need no other test, so a large group isn't
    compared all with all. Shingles and texts are told apart by 64-bit hashes.

    Nulls: a null text has no words; texts without words link. A null doc_id keeps its row and takes part,
    but is no component_id unless its whole component has none. Repeated rows come out each. Empty in, empty out.
    """
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity is above 0 and up to 1, a shingle has a word or more")
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_classes(shingle), "doc_id long, text string, cls long, bits binary, n int, fp long")
    texts = cut(keyed.groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    # so many rows has the prefix join at most
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.floor(F.col("n") * (1 - similarity)) + 1).alias("firsts")).first()
    n, firsts = max(1, size["n"]), size["firsts"] or 0
    texts = fitted(texts, math.ceil(max(n / TEXTS_A_TASK, (size["bytes"] or 0) / BYTES_A_TASK)), 1)
    sample = texts.where(F.pmod(F.xxhash64(F.lit("order"), "cls"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SAMPLED / n))))
    top = sample.select("text").mapInArrow(_all_shingles(shingle), "h long").groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    common, counts = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(common)
    box = Shipped(spark, (common[order], counts[order]))
    rows = texts.select("cls", "text").mapInArrow(_prefixes(shingle, similarity, box), "h long, cls long, n int, pos int")
    live = cut(fitted(rows.repartition(partitions(spark), "h"), firsts).sortWithinPartitions("h", "n", "cls").mapInArrow(_shared, "h long, cls long, n int, pos int, hub long, hub_n int"))

    def close(x, y):  # sizes that allow the similarity
        return F.least(x, y) >= F.greatest(x, y) * (similarity - 1e-9)

    def may_be_first(x, y):
        # where a pair meets in its first common shingle, no more than what follows it in both is shared; every pair meets there
        return F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= (x["n"] + y["n"]) * (similarity / (1 + similarity)) - 1e-6

    def verified(pairs, about):  # how many pairs there may be
        # parity bits, a thirtieth of the texts, rule out nearly all pairs before texts are fetched
        bits = lambda k: texts.select(F.col("cls").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
        pairs = fitted(fitted(pairs, about).distinct(), about).join(bits("a"), "a")
        pairs = cut(fitted(fitted(pairs, about).join(bits("b"), "b"), about).mapInArrow(_possible(similarity), "a long, b long"))
        about = pairs.count()
        # only the texts of these pairs are shuffled
        ids = cut(fitted(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), 2 * about))
        own = texts.select("cls", "text").join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "cls", "left_semi")
        of_a = own.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
        of_b = own.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
        both = fitted(fitted(pairs.join(of_a, "a"), about, TEXTS_A_TASK).join(of_b, "b"), about, TEXTS_A_TASK)
        return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, similarity), "a long, b long"))

    # SimHash: of the texts of a fingerprint the first stands for all
    prints = cut(fitted(texts.groupBy("fp").agg(F.min("cls").alias("cls")), n))
    of = lambda k: prints.select(F.col("fp").alias(k), F.col("cls").alias(f"cls_{k}"))
    near = fitted(fitted(near_fingerprints(prints), n * (2 * SEGMENTS + 1)).distinct(), n).join(of("a"), "a")
    near = fitted(fitted(near, n).join(of("b"), "b"), n).select("cls_a", "cls_b")
    equal = fitted(texts.select("fp", F.col("cls").alias("cls_b")).join(of("fp"), "fp"), n).where("cls_fp <> cls_b").select("cls_fp", "cls_b")
    printed = near.union(equal).select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))

    # hubs of a shingle: its middle text by size, and the one that shares most of its first shingles, as a text does that its
    # near copies were made from
    degree = live.groupBy("cls").agg(F.count("*").alias("d"))
    most = fitted(live.select("h", "cls", "n").join(degree, "cls"), firsts).groupBy("h").agg(F.max(F.struct("d", "cls", "n")).alias("most"))
    tried = fitted(live.join(most, "h"), firsts).select("cls", "n", F.explode(F.array(F.struct(F.col("hub").alias("cls"), F.col("hub_n").alias("n")), F.struct("most.cls", "most.n"))).alias("hub"))
    tried = tried.where((F.col("cls") != F.col("hub.cls")) & close(F.col("n"), F.col("hub.n")))
    # verified in one round with SimHash's pairs: each round of components takes much of the driver's memory
    stars = verified(printed.union(tried.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"))), 2 * firsts + n)
    roots = cut(components(stars))
    parts = fitted(live.select("h", "cls", "n", "pos").join(roots, live["cls"] == roots["node"], "left"), firsts).select("h", F.struct("cls", "n", "pos").alias("m"), F.coalesce("root", "cls").alias("part"))
    mixed = parts.groupBy("h").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select("h")
    left = cut(fitted(parts.join(mixed, "h", "left_semi"), firsts))
    met_at = left.count()
    left = fitted(left, met_at)
    x, y = left.alias("x"), left.alias("y")
    met = (F.col("x.h") == F.col("y.h")) & (F.col("x.m.cls") < F.col("y.m.cls")) & (F.col("x.part") != F.col("y.part")) & close(F.col("x.m.n"), F.col("y.m.n"))
    rest = x.join(y, met & may_be_first(F.col("x.m"), F.col("y.m"))).select(F.col("x.m.cls").alias("a"), F.col("y.m.cls").alias("b"))
    links = stars.union(verified(rest, max(firsts, 10 * met_at)))
    roots = cut(components(links))
    linked = fitted(texts.select("cls", "least").join(roots, texts["cls"] == roots["node"], "left"), n).select("cls", "least", F.coalesce("root", "cls").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = fitted(linked.join(smallest, "root"), n).select(F.col("cls").alias("__cls"), "component_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_keys, "doc_id long, cls long")
    return ids.join(of_class, F.col("cls") == F.col("__cls")).select("doc_id", "component_id")
