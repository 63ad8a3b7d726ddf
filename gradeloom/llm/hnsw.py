"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard, shard results merged."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Shipped, cut, partitions, usable_vector
from gradeloom.llm.mixing import hashed_unit

#: Distinct vectors of a shard, links of a node (twice as many on the ground level), beam widths.
SHARD, LINKS, BUILD_BEAM, SEARCH_BEAM = 8000, 12, 40, 160
#: Vectors that the cells are fitted on, at most (in expectation: chosen by a hash); the most cells.
SAMPLE, MOST_CELLS = 20_000, 2000
#: Cells that a query is searched in, nearest first: all of them. On the given vectors a sixth of the cells finds 0.59 of the
#: neighbours and a third 0.79, so fewer are a choice for data that falls into clusters.
PROBES = MOST_CELLS
#: Queries that are searched together in one group.
QUERY_BLOCK = 2048


class Graph:
    """Flat arrays: for each level a (nodes, width) table of neighbours, -1 where there is none."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float64)
        self.sq = (self.x * self.x).sum(axis=1)
        n = len(x)
        self.level = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS), 12).astype(np.int32)
        self.near = [np.full((n, LINKS * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(self.level.max(initial=0)) + 1)]
        self.fill = [np.zeros(n, np.int32) for _ in self.near]
        self.entry = 0

    def far(self, q: np.ndarray, qq: float, ids) -> np.ndarray:
        return self.sq[ids] - 2.0 * (self.x[ids] @ q) + qq

    def beam(self, q: np.ndarray, start: list, width: int, lv: int, seen: np.ndarray, mark: int) -> list:
        """Best-first search of one level from ``start`` [(distance, node)]; the ``width`` nearest, ascending."""
        near, qq = self.near[lv], float(q @ q)
        ahead, best = list(start), [(-d, i) for d, i in start]
        heapq.heapify(ahead)
        heapq.heapify(best)
        for _, i in start:
            seen[i] = mark
        while ahead:
            d, i = heapq.heappop(ahead)
            if len(best) >= width and d > -best[0][0]:
                break
            around = near[i, : self.fill[lv][i]]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            ds = self.far(q, qq, around)
            if len(best) >= width:
                closer = ds < -best[0][0]
                around, ds = around[closer], ds[closer]
            for d, j in zip(ds.tolist(), around.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-d, j))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, j))
                else:
                    continue
                heapq.heappush(ahead, (d, j))
        return sorted((-d, i) for d, i in best)

    def spread(self, found: list, most: int) -> list:
        """Neighbours that are nearer to the node than to one chosen before, then the nearest of the rest."""
        ids = np.array([i for _, i in found])
        x = self.x[ids]
        between = self.sq[ids][:, None] + self.sq[ids][None, :] - 2.0 * (x @ x.T)
        chosen, rest = [], []
        for k, (d, _) in enumerate(found):
            if len(chosen) < most and (not chosen or between[k, chosen].min() > d):
                chosen.append(k)
            else:
                rest.append(k)
        return [found[k] for k in (chosen + rest)[:most]]

    def tie(self, a: int, b: int, d: float, lv: int) -> None:
        near, fill = self.near[lv], self.fill[lv]
        if fill[a] < near.shape[1]:
            near[a, fill[a]] = b
            fill[a] += 1
            return
        ids = np.append(near[a], b)
        ds = self.far(self.x[a], self.sq[a], ids)
        order = np.argsort(ds, kind="stable")
        near[a] = [i for _, i in self.spread([(float(ds[k]), int(ids[k])) for k in order], near.shape[1])]

    def build(self) -> Graph:
        seen, mark = np.zeros(len(self.x), np.int64), 0
        for i in range(1, len(self.x)):
            q, top = self.x[i], int(self.level[self.entry])
            at = [(float(self.far(q, self.sq[i], np.array([self.entry]))[0]), self.entry)]
            for lv in range(top, -1, -1):
                mark += 1
                at = self.beam(q, at, 1 if lv > self.level[i] else BUILD_BEAM, lv, seen, mark)
                if lv <= self.level[i]:
                    ties = self.spread(at, LINKS)
                    for d, j in ties:
                        self.tie(i, j, d, lv)
                        self.tie(j, i, d, lv)
            if self.level[i] > top:
                self.entry = i
        return self

    def search(self, q: np.ndarray, beam: int, seen: np.ndarray, mark: int) -> tuple[list, int]:
        at = [(float(self.far(q, float(q @ q), np.array([self.entry]))[0]), self.entry)]
        for lv in range(int(self.level[self.entry]), -1, -1):
            mark += 1
            at = self.beam(q, at, 1 if lv else beam, lv, seen, mark)
        return at, mark

    def row(self) -> dict:
        """The graph as flat binary arrays."""
        return {"entry": self.entry, "levels": self.level.tobytes(), "widths": [a.shape[1] for a in self.near], "near": [a.tobytes() for a in self.near], "fill": [a.tobytes() for a in self.fill]}

    @classmethod
    def of_row(cls, r, dim: int, dtype) -> Graph:
        g = cls.__new__(cls)
        g.x = np.frombuffer(r["vectors"], dtype).reshape(-1, dim).astype(np.float64)
        g.sq = (g.x * g.x).sum(axis=1)
        g.level, g.entry = np.frombuffer(r["levels"], np.int32), int(r["entry"])
        g.near = [np.frombuffer(b, np.int32).reshape(-1, w) for b, w in zip(r["near"], r["widths"])]
        g.fill = [np.frombuffer(b, np.int32) for b in r["fill"]]
        return g


class Cells:
    """Centroids for each length of vectors; a vector's cell is the nearest one. A length without any is one cell."""

    def __init__(self, sample: dict[int, np.ndarray], cells: int, rounds: int = 6):
        self.of: dict[int, np.ndarray] = {}
        for dim, x in sample.items():
            c = x[np.random.default_rng([7, dim]).permutation(len(x))[:cells]]
            for _ in range(rounds if cells > 1 else 0):
                own = self.nearest(x, c, 1)[:, 0]
                n = np.bincount(own, minlength=len(c))
                sums = np.zeros_like(c)
                np.add.at(sums, own, x)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            self.of[dim] = c

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
        out = np.empty((len(x), min(most, len(c))), np.int64)
        for at in range(0, len(x), 1024):
            d = (c * c).sum(axis=1) - 2.0 * (x[at : at + 1024] @ c.T)
            out[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
        return out

    def probes(self, raws: list[bytes], dtype, most: int) -> list[list[int]]:
        """The cells of some vectors, nearest first."""
        out: list = [[0]] * len(raws)
        width = np.dtype(dtype).itemsize
        by: dict[int, list[int]] = {}
        for i, r in enumerate(raws):
            by.setdefault(len(r) // width, []).append(i)
        for dim, at in by.items():
            if dim in self.of:
                x = np.frombuffer(b"".join(raws[i] for i in at), dtype).reshape(-1, dim).astype(np.float64)
                for i, cells in zip(at, self.nearest(x, self.of[dim], most).tolist()):
                    out[i] = cells
        return out


def _raw_of(v, dtype) -> bytes:
    return (np.asarray(v, dtype) + dtype(0)).tobytes()


def _collapse(most, box, dtype):
    """Within a task: each distinct vector once, with its cell and its ``most`` smallest ids (a result of k can use no more)."""

    def run(batches):
        cells, held = box.get(), {}
        for p in batches:
            for i, v in zip(p["vec_id"].to_numpy(), p["vec"]):
                ids = held.setdefault(_raw_of(v, dtype), [])
                if -int(i) not in ids:
                    heapq.heappush(ids, -int(i))
                    if len(ids) > most:
                        heapq.heappop(ids)
            if len(held) >= 20_000:
                yield _held(held, cells)
                held = {}
        if held:
            yield _held(held, cells)

    def _held(held, cells):
        raws = list(held)
        return pd.DataFrame({"raw": raws, "ids": [sorted(-i for i in ids) for ids in held.values()], "cell": [c[0] for c in cells.probes(raws, dtype, 1)]})

    return run


def _index(most, dtype):
    def run(p):
        held: dict[bytes, set[int]] = {}
        for raw, ids in zip(p["raw"], p["ids"]):
            held.setdefault(raw, set()).update(int(i) for i in ids)
        raws = sorted(held)
        members = [sorted(held[r])[:most] for r in raws]
        vectors = b"".join(raws)
        g = Graph(np.frombuffer(vectors, dtype).reshape(len(raws), -1)).build()
        key = {c: int(p[c].iat[0]) for c in ("cell", "sub", "dim")}
        return pd.DataFrame([{**key, **g.row(), "vectors": vectors, "ids": np.concatenate(members).astype(np.int64).tobytes(), "n_ids": np.array([len(m) for m in members], np.int32).tobytes()}])

    return run


INDEX = "cell int, sub int, dim int, entry int, levels binary, widths array<int>, near array<binary>, fill array<binary>, vectors binary, ids binary, n_ids binary"
SHARD_KEY = ["cell", "sub", "dim"]


def _plain(df: DataFrame, id_name: str) -> DataFrame:
    """Usable rows as (id, vec); an id or vector that is null, zero or not finite takes no part."""
    v = df.select(F.col("vec_id").cast("long").alias(id_name), F.col("embedding").cast("array<double>").alias("vec"))
    return v.where(usable_vector(F.col("vec")) & F.col(id_name).isNotNull())


def _width(df: DataFrame):
    return np.float32 if df.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64


def fit_cells(vectors: DataFrame, shard: int) -> Cells:
    """Cells of about ``shard`` vectors, fitted on ``SAMPLE`` of them (by a hash of vec_id), ``MOST_CELLS`` at most."""
    v = _plain(vectors, "vec_id")
    n = v.count()
    take = v if n <= SAMPLE else v.where(hashed_unit(F.lit("cells"), "vec_id") < F.lit(SAMPLE / n))
    by: dict[int, list] = {}
    for r in take.orderBy("vec_id", "vec").collect():  # bounded by SAMPLE
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    return Cells({d: np.array(x) for d, x in by.items()}, min(MOST_CELLS, max(1, math.ceil(n / shard))))


def build_index(vectors: DataFrame, cells: Cells, k: int = 10, shard: int = SHARD) -> DataFrame:
    """One row a shard: the graph's flat neighbour arrays, its distinct vectors, and the ids of each of them. Written once.

    A shard is a cell of near vectors, or a part of one by hash where the cell holds more than twice ``shard``
    of them, so no shard grows with the input. Equal vectors meet in one shard; they are one node with at most k + 1 ids, the smallest ones (k
    results, the query's own id aside, can't reach beyond these).
    """
    spark, dtype = vectors.sparkSession, _width(vectors)
    one = _plain(vectors, "vec_id").mapInPandas(_collapse(k + 1, Shipped(spark, cells), dtype), "raw binary, ids array<long>, cell int")
    one = cut(one.withColumn("dim", (F.octet_length("raw") / np.dtype(dtype).itemsize).cast("int")))
    n = one.count()
    parts = one.groupBy(F.col("cell").alias("__c"), F.col("dim").alias("__d")).agg(F.ceil(F.count("*") / F.lit(2 * shard)).cast("int").alias("subs"))
    dealt = one.join(parts, (F.col("cell") == F.col("__c")) & (F.col("dim") == F.col("__d"))).withColumn("sub", F.pmod(F.xxhash64("raw"), F.col("subs")).cast("int"))
    dealt = dealt.select(*SHARD_KEY, "raw", "ids").repartition(max(partitions(spark), min(2 * math.ceil(n / shard), 100_000)), *SHARD_KEY)
    return cut(dealt.groupBy(*SHARD_KEY).applyInPandas(_index(k + 1, dtype), INDEX))


def _search(k, beam, dtype):
    def run(index, queries):
        if not len(index) or not len(queries):
            return pd.DataFrame({"raw": [], "vec_id": [], "score": []}).astype({"raw": "object", "vec_id": "int64", "score": "float64"})
        r = index.iloc[0]
        g = Graph.of_row(r, int(r["dim"]), dtype)
        n_ids = np.frombuffer(r["n_ids"], np.int32)
        ids, ends = np.frombuffer(r["ids"], np.int64), np.cumsum(n_ids)
        seen, mark, out = np.zeros(len(g.x), np.int64), 0, []

        def by_id(q, nodes):
            d, near = np.sqrt(((g.x[nodes] - q) ** 2).sum(axis=1)), {}
            for s, node in sorted(zip(d.tolist(), nodes.tolist())):
                for i in ids[ends[node] - n_ids[node] : ends[node]].tolist():
                    near.setdefault(i, s)
            return near

        for raw in queries["raw"]:
            q = np.frombuffer(raw, dtype).astype(np.float64)
            at, mark = g.search(q, max(beam, k + 1), seen, mark)
            near = by_id(q, np.array([i for _, i in at]))
            if len(near) <= k and len(at) < len(g.x):  # many vectors of few ids are nearest: all nodes are compared
                near = by_id(q, np.arange(len(g.x)))
            out += [(raw, i, s) for s, i in heapq.nsmallest(k + 1, ((s, i) for i, s in near.items()))]  # one more, for the query's own id
        return pd.DataFrame(out, columns=["raw", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM, shard: int = SHARD, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest found rows of ``vectors`` for each query: (query_id, rank, vec_id, score).

    Both have vec_id and embedding, of the same width. The score is the Euclidean distance of the original
    vectors in double precision; ties go to the smaller vec_id. Every usable row is indexed: vectors are
    dealt to cells by the nearest centroid, each cell is a graph (or some, if it is large), and every
    distinct query vector is searched in its ``probes`` nearest cells, by default in all, and their results are
    merged. So recall is that of the graphs at every size, and a query's work grows with the number of shards. The index is written once, and a shard's row is read again only for each
    ``QUERY_BLOCK`` queries that are sent to it.

    A row with the query's own id is no result. Rows that repeat an id with an equal vector count once; a
    candidate id with several vectors counts by its nearest one, a query id with several vectors by the
    smallest of them in byte order. Null ids and vectors that are null, zero or hold null or non-finite
    components take no part. With fewer than k candidates in the probed cells those are returned; an empty
    table gives an empty result.
    """
    spark, dtype = vectors.sparkSession, _width(vectors)
    cells = fit_cells(vectors, shard)
    index = build_index(vectors, cells, k, shard)
    box = Shipped(spark, cells)  # at most MOST_CELLS centroids a length

    def raw(batches):
        for p in batches:
            yield pd.DataFrame({"query_id": p["query_id"], "raw": [_raw_of(v, dtype) for v in p["vec"]]})

    def sent(batches):
        cells = box.get()
        for p in batches:
            yield pd.DataFrame({"raw": p["raw"], "cells": cells.probes(list(p["raw"]), dtype, probes)})

    q = _plain(queries, "query_id").mapInPandas(raw, "query_id long, raw binary").groupBy("query_id").agg(F.min("raw").alias("raw"))
    q = cut(q)
    dim = (F.octet_length("raw") / np.dtype(dtype).itemsize).cast("int").alias("dim")
    to = q.select("raw").distinct().mapInPandas(sent, "raw binary, cells array<int>").select("raw", dim, F.explode("cells").alias("cell"))
    subs = index.groupBy("cell", "dim").agg(F.collect_list("sub").alias("subs"))
    to = cut(to.join(subs, ["cell", "dim"]).select("raw", "cell", "dim", F.explode("subs").alias("sub")))
    # queries of a shard are searched in blocks; the shard's row goes to each of them
    blocks = to.groupBy(*SHARD_KEY).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    to = to.join(blocks, SHARD_KEY).withColumn("block", F.pmod(F.xxhash64("raw"), F.col("blocks")).cast("int"))
    graphs = index.join(blocks, SHARD_KEY).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*SHARD_KEY, "block"]
    n = max(partitions(spark), min(index.count(), 100_000))
    found = graphs.drop("blocks").repartition(n, *keys).groupBy(*keys).cogroup(to.select("raw", *keys).repartition(n, *keys).groupBy(*keys)).applyInPandas(_search(k, beam, dtype), "raw binary, vec_id long, score double")
    best = Window.partitionBy("raw").orderBy("score", "vec_id")
    once = found.groupBy("raw", "vec_id").agg(F.min("score").alias("score")).withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k + 1).drop("__r")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = q.join(once, "raw").where("query_id <> vec_id").withColumn("rank", F.row_number().over(w))
    return pairs.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
