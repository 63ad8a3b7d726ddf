"""Near-duplicate vectors: p-stable hashing for the Euclidean distance, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Forest, cut, partitions, sorted_runs, usable_vector
from gradeloom.llm.components import components

#: Share of the pairs right at the limit that meet in some table; closer pairs meet more often.
MEET = 0.99
#: A projection's width, in distances of a pair at the limit, and the least and most projections of a key.
WIDTH, FEWEST, MOST = 4.0, 4, 16
#: Unrelated classes of a label that share a bucket with a class, about: projections are chosen for it by the label's size.
STRANGERS = 8
#: Buckets above this size are compared in blocks of it, each pair of blocks in a group of its own; rows of a block compared at once.
BLOCK, ROWS = 4096, 512
#: Vectors and projections are hashed as whole numbers of these steps: sums stay below 2**53, so keys are exact.
STEPS, A_STEPS = 1 << 20, 1 << 14
#: Sizes of labels and of big buckets are broadcast up to this number of rows, and joined by a shuffle beyond it.
MOST_BROADCAST = 200_000
#: Hashed rows that a task makes at once.
AT_ONCE = 100_000


def agree(t: float) -> float:
    """How often one projection of width t times their distance puts two vectors into one bucket."""
    return 1 - math.erfc(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


class Hashing:
    """Width, and tables for each number of projections, for a least cosine."""

    def __init__(self, cosine: float, seed: int = 5):
        self.seed, far = seed, math.sqrt(max(2 - 2 * cosine, 1e-6))
        self.width = WIDTH * far
        self.near, self.strange = agree(WIDTH), agree(self.width / math.sqrt(2))  # unrelated unit vectors are sqrt(2) apart
        self.known: dict = {}

    def tables(self, k: int) -> int:
        return max(1, math.ceil(math.log(1 / (1 - MEET)) / -math.log1p(-(self.near**k))))

    def projections(self, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if (dim, k) not in self.known:
            r, n = np.random.default_rng([self.seed, dim, k]), self.tables(k) * k
            a, b = r.standard_normal((dim, n)), r.uniform(0, self.width, n)
            self.known[dim, k] = np.rint(a * A_STEPS), np.rint(b * STEPS * A_STEPS)
        return self.known[dim, k]

    def keys(self, x: np.ndarray, k: int) -> np.ndarray:
        """(vectors, tables) of keys, mixed from the quantised projections of unit vectors; the same wherever computed."""
        a, b = self.projections(x.shape[1], k)
        q = np.floor((np.rint(x * STEPS) @ a + b) / (self.width * STEPS * A_STEPS)).astype(np.int64).view(np.uint64).reshape(len(x), -1, k)
        key = np.full(q.shape[:2], 0x9E3779B97F4A7C15, np.uint64)
        for j in range(k):
            key = (key ^ q[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(hashing: Hashing, dtype):
    """One row a table for each class; ``raw`` has the vector in its own width."""

    def run(batches):
        for b in batches:
            lab, cid, size, kinds, vec = (b.column(c) for c in ("lab", "cid", "size", "k", "vec"))
            lengths, ks = vec.value_lengths().to_numpy(), kinds.to_numpy()
            flat, starts = vec.flatten().to_numpy(), np.cumsum(lengths) - lengths
            for dim, k in np.unique(np.stack([lengths, ks]), axis=1).T.tolist():
                tables, every = hashing.tables(k), np.flatnonzero((lengths == dim) & (ks == k))
                step = max(1, AT_ONCE // tables)
                for i in range(0, len(every), step):
                    at = every[i : i + step]
                    x = flat[starts[at][:, None] + np.arange(dim)]
                    take = pa.array(np.repeat(at, tables))
                    raw = pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), tables)))
                    tab = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at)))
                    columns = [lab.take(take), tab, pa.array(hashing.keys(unit(x), k).reshape(-1)), cid.take(take), size.take(take), kinds.take(take), raw]
                    yield pa.RecordBatch.from_arrays(columns, ["lab", "tab", "key", "cid", "size", "k", "raw"])

    return run


HASHED = "lab long, tab int, key long, cid long, size long, k int, raw binary"


def _compare(hashing: Hashing, cosine, dtype, keys):
    """Of each part of a bucket, in rows sorted by ``keys``: the links of each vector, counted, and a forest of them."""

    def unit_of(raw):
        return unit(np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64))

    def first_met(x, i, j, tab, k):
        """True for pairs that no earlier table has brought together, so that a link counts once."""
        if not tab:
            return np.ones(len(i), bool)
        who, of = np.unique(np.concatenate((i, j)), return_inverse=True)
        met, out = hashing.keys(x[who], k)[:, :tab], np.empty(len(i), bool)
        a, b = of[: len(i)], of[len(i) :]
        for at in range(0, len(i), 1 << 16):
            out[at : at + (1 << 16)] = ~(met[a[at : at + (1 << 16)]] == met[b[at : at + (1 << 16)]]).any(axis=1)
        return out

    def one(tab: int, k: int, side, cid, size, x):
        same = side[0] == side[-1] and (side == side[0]).all()
        if same and len(x) <= ROWS and np.count_nonzero(x @ x.T >= cosine - 1e-9) <= len(x):
            return None  # only each vector with itself
        rows, cols = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, forest, edges = np.zeros(len(x), np.int64), Forest(len(x)), []
        for at in range(0, len(rows), ROWS):
            r = rows[at : at + ROWS]
            near = exact_at_least(x, r, cols, cosine)
            if same:
                near &= cols[None, :] > r[:, None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = r[i], cols[j]
            new = first_met(x, i, j, tab, k)
            links += np.bincount(i[new], size[j[new]], len(x)).astype(np.int64) + np.bincount(j[new], size[i[new]], len(x)).astype(np.int64)
            for a, b in zip(i.tolist(), j.tolist()):
                if forest.join(a, b):
                    edges.append((a, b))
        hit = np.flatnonzero(links)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return np.concatenate((cid[hit], cid[a])), np.concatenate((cid[hit], cid[b])), np.concatenate((links[hit], np.zeros(len(a), np.int64)))

    def run(batches):
        for t, bounds in sorted_runs(batches, keys):
            tab, k, side, cid, size = (t[c].to_numpy() for c in ("tab", "k", "side", "cid", "size"))
            raw, dim = t["raw"].to_pylist(), t["dim"].to_numpy()
            x = unit_of(raw) if (dim == dim[0]).all() else None
            out = [one(int(tab[i]), int(k[i]), side[i:j], cid[i:j], size[i:j], unit_of(raw[i:j]) if x is None else x[i:j]) for i, j in bounds if j > i + 1]
            out = [o for o in out if o is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "n"])

    return run


def exact_at_least(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, cosine: float) -> np.ndarray:
    """Cosines in double precision; those within rounding of the limit are summed anew, one by one."""
    c = x[rows] @ x[cols].T
    out = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-9)):
        out[i, j] = float((x[rows[i]] * x[cols[j]]).sum()) >= cosine
    return out


def _small(df: DataFrame) -> DataFrame:
    """Written once, and broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def vector_links(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label of any type).

    Rows of equal, non-null labels link where their cosine is at least ``cosine``. Equal vectors of a label
    are one class with a count, so copies are never paired. Every class is hashed into tables whose keys have
    more projections the more classes its label has, and more tables for them: a class meets about
    ``STRANGERS`` unrelated ones a table at every size, and a pair at the limit meets with probability
    ``MEET``. Classes that share a bucket are compared exactly, and a pair counts in the first table in which
    it meets. Buckets above ``BLOCK`` classes are split into pairs of blocks. Only counts and a forest of the
    links leave a bucket; components come from the forests.

    Vectors that are null, zero or hold null or non-finite components, and vectors with a null label, link
    with nothing and come out alone. Vectors of different lengths never link. Classes have keys of their own,
    so rows that repeat a vec_id count as different rows: equal ones link with each other, those with another
    vector or label have their own links. A row with a null vec_id links with nothing and has a null component_id.
    """
    spark, hashing = vectors.sparkSession, Hashing(cosine)
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    good = base.where(usable_vector(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    # ids of a written table: they stay whatever is computed again
    classes = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).withColumn("cid", F.monotonically_increasing_id()))
    by_size = F.ceil(F.log(F.col("m") / F.lit(float(STRANGERS))) / F.lit(-math.log(hashing.strange)))
    labels = _small(classes.groupBy(F.col("label").alias("__l")).agg(F.count("*").alias("m")).select("__l", F.least(F.greatest(by_size, F.lit(FEWEST)), F.lit(MOST)).cast("int").alias("k"), F.monotonically_increasing_id().alias("lab")))
    dtype = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    hashed = classes.join(labels, F.col("label") == F.col("__l")).select("lab", "cid", "size", "k", "vec").mapInArrow(_hash(hashing, dtype), HASHED).withColumn("dim", F.octet_length("raw"))
    bucket = ["lab", "tab", "key", "dim"]
    big = _small(hashed.groupBy(*bucket).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK))
    spread = (
        hashed.join(big, bucket, "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        # block pair (lo, hi): a class goes to each pair that its block is part of
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .withColumn("side", F.when(F.col("own") == F.col("lo"), 0).otherwise(1))
    )
    parts = [*bucket, "lo", "hi"]
    near = spread.select(*parts, "side", "cid", "size", "k", "raw").repartition(partitions(spark), *parts).sortWithinPartitions(*parts)
    found = cut(near.mapInArrow(_compare(hashing, cosine, dtype, parts), "a long, b long, n long"))
    roots = cut(components(found.where("a <> b").select("a", "b")))
    counted = found.where("n > 0").groupBy(F.col("a").alias("__a")).agg(F.sum("n").alias("__n"))
    least = classes.select("cid", "least").join(roots, F.col("cid") == F.col("node")).groupBy("root").agg(F.min("least").alias("__least"))
    component = roots.join(cut(least), "root").select(F.col("node").alias("__node"), "__least")
    per_class = (
        classes.join(counted, F.col("cid") == F.col("__a"), "left")
        .join(component, F.col("cid") == F.col("__node"), "left")
        .select(F.col("label").alias("__label"), F.col("vec").alias("__vec"), (F.col("size") - 1 + F.coalesce("__n", F.lit(0))).alias("n_links"), F.coalesce("__least", "least").alias("component_id"))
    )
    rows = base.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).withColumn("__ok", usable_vector(F.col("vec")) & F.col("vec_id").isNotNull())
    out = rows.join(per_class, F.col("__ok") & (rows["label"] == F.col("__label")) & (rows["vec"] == F.col("__vec")), "left")
    of = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("vec_id") == of, F.lit(True)).alias("kept"))


#: DuckDB's twin of ``op5``, over all pairs of a label. Spark finds links by hashing: all of them on the given tables.
LINK_SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
reach AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b) SELECT * FROM r))
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1) USING (vec_id)
"""
