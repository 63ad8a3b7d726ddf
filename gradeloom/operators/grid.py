"""Joins of boxes and points on pages by a grid of cells, and clusters of near boxes, so that a page's rows spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.sources.store import written

#: The side of a cell, and cells a page has along a side; what lies beyond belongs to the outermost ones.
CELL, MOST = 128.0, 64
#: Groups of up to so many boxes are clustered by one task each; larger ones by the grid.
WHOLE = 2000


def slot(x: Column, cell: float = CELL, most: int = MOST) -> Column:
    """The cell along one side. It never falls as ``x`` rises, so a point in a box has its cell between those of the box's edges."""
    return F.least(F.lit(most - 1), F.greatest(F.lit(0), F.floor(x.cast("double") / cell))).cast("int")


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: list[str], x: Column, y: Column, holds: Column) -> DataFrame:
    """Points joined to the boxes (b_x0, b_y0, b_x1, b_y1) of their group that ``holds`` them; every pair once.

    A point is in one cell and a box in all that it covers, so a group's points are compared cell by cell.
    """
    p = points.withColumns({"__cx": slot(x), "__cy": slot(y)})
    side = lambda a, b: F.explode(F.sequence(slot(F.col(a)), F.greatest(slot(F.col(a)), slot(F.col(b)))))
    b = boxes.withColumn("__cx", side("b_x0", "b_x1")).withColumn("__cy", side("b_y0", "b_y1"))
    return p.join(b, [*by, "__cx", "__cy"]).where(holds).drop("__cx", "__cy")


def in_bands(df: DataFrame, y0: Column, y1: Column) -> DataFrame:
    """Each row in all bands of y that it covers; ``y1`` below ``y0`` counts as ``y0``."""
    return df.withColumn("__band", F.explode(F.sequence(slot(y0), F.greatest(slot(y0), slot(y1)))))


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Arrow batches that are sorted by ``by`` (no nulls), cut again so that no group spans two, each with its rows' group numbers."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        g = _numbers(t, by)
        end = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
        if end:
            yield t.slice(0, end), g[:end]
        held = t.slice(end)
    if held is not None and held.num_rows:
        yield held, _numbers(held, by)


def _numbers(t: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in by:
        c = t[k].combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _near_boxes(by, key, px):
    """The clusters of whole groups: along the boxes' left edges each meets those that begin within ``px`` of its right edge."""

    def joined(up, i, j):
        while True:
            a, b = up[i], up[j]
            if (apart := a != b).sum() == 0:
                return up
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]

    def run(batches):
        for t, g in whole_groups(batches, by):
            x0, y0, x1, y1 = (t[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
            first = np.ones(len(g), bool)  # of the rows of a key
            first[1:] = (g[1:] != g[:-1]) | pc.not_equal(t[key].combine_chunks()[1:], t[key].combine_chunks()[:-1]).to_numpy(zero_copy_only=False)
            same = np.flatnonzero(~first)
            up = joined(np.arange(len(g)), same - 1, same)  # rows are sorted by key, so a cluster's first row has its smallest
            at = np.lexsort((x0, g))
            alive, gap = np.arange(len(g)), 1
            while len(alive := alive[alive + gap < len(g)]):
                i, j = at[alive], at[alive + gap]
                reach = (g[i] == g[j]) & (x0[j] - x1[i] <= px)
                alive, i, j = alive[reach], i[reach], j[reach]
                near = (y0[j] - y1[i] <= px) & (y0[i] - y1[j] <= px)
                up = joined(up, i[near], j[near])
                gap += 1
            named = t.select([*by, key]).append_column("cluster", t[key].take(pa.array(up)))
            yield from named.filter(pa.array(first)).combine_chunks().to_batches()

    return run


def clusters(boxes: DataFrame, by: list[str], key: str, px: float) -> DataFrame:
    """(by, key, cluster): boxes (x0, y0, x1, y1) that are within ``px`` of each other across and down, directly or by way of
    others, share the smallest ``key`` among them.

    Boxes are dealt out by group once. Groups of more than ``WHOLE`` boxes, and those that hold a null, an edge that isn't finite
    or edges in the wrong order, go by the grid instead, which spreads a group over tasks.
    """
    if px <= 0:
        raise ValueError("px has to be above 0")
    edges = ("x0", "y0", "x1", "y1")
    b = boxes.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in by))).select(*by, key, *[F.col(c).cast("double").alias(c) for c in edges])
    plain = F.col(key).isNotNull() & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    for c in edges:
        plain = plain & (F.abs(F.col(c)) < float("inf"))
    other = written(b.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.coalesce(plain, F.lit(False))).alias("plain")).where((F.col("n") > WHOLE) | ~F.col("plain")).select(*by))
    some = not other.isEmpty()
    small = b.join(other, by, "left_anti") if some else b
    schema = b.select(*by, key, F.col(key).alias("cluster")).schema
    found = small.repartition(*by).sortWithinPartitions(*by, key).mapInArrow(_near_boxes(by, key, px), schema)
    return found.unionByName(grid_clusters(b.join(other, by, "left_semi"), by, key, px)) if some else found


def grid_clusters(boxes: DataFrame, by: list[str], key: str, px: float) -> DataFrame:
    """What ``clusters`` gives, with a group's boxes spread over tasks.

    Cells are ``px`` wide, so all boxes that touch a cell are one cluster, and cells next to each other in a row or
    column are joined by their extreme edges alone; corner to corner, one ordered pass finds whether any two boxes are
    near. No two boxes are ever paired. Cells that belong together take each other's smallest key until none changes.
    """
    at = lambda c: F.floor(F.col(c) / px).cast("long")
    span = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), at(b))))
    edges = ("x0", "y0", "x1", "y1")
    covered = written(boxes.select(*by, key, *edges).withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")))
    cell = [*by, "cx", "cy"]
    ends = covered.groupBy(*cell).agg(F.min(key).alias("label"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    other = lambda dx, dy: ends.select(*by, (F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.col("x0").alias("o_x0"), F.col("y0").alias("o_y0"))
    link = lambda df, dx, dy: df.select(*by, "cx", "cy", (F.col("cx") + dx).alias("tx"), (F.col("cy") + dy).alias("ty"))
    links = link(ends.join(other(1, 0), cell).where(F.col("o_x0") - F.col("x1") <= px), 1, 0)
    links = links.union(link(ends.join(other(0, 1), cell).where(F.col("o_y0") - F.col("y1") <= px), 0, 1))
    for dy in (1, -1):
        # boxes a of a cell against boxes b of the cell to the right, above or below: a's right edge has to reach b's left, and
        # their edges up and down each other; in order of the edges across, the extreme edge so far answers for all of a
        a = covered.select(*by, "cx", "cy", (-F.col("x1") - px).alias("o"), F.lit(0).alias("kind"), (F.col("y1") if dy == 1 else -F.col("y0")).alias("edge"))
        b = covered.select(*by, (F.col("cx") - 1).alias("cx"), (F.col("cy") - dy).alias("cy"), (-F.col("x0")).alias("o"), F.lit(1).alias("kind"), (F.col("y0") if dy == 1 else -F.col("y1")).alias("edge"))
        reach = F.max(F.when(F.col("kind") == 0, F.col("edge"))).over(Window.partitionBy(*cell).orderBy("o", "kind").rowsBetween(Window.unboundedPreceding, -1))
        found = a.union(b).withColumn("reach", reach).where((F.col("kind") == 1) & (F.col("edge") - F.col("reach") <= px)).select(*cell).distinct()
        links = links.union(link(found, 1, dy))
    wide = covered.groupBy(*by, key).agg(F.min(F.struct("cx", "cy")).alias("c"), F.count("*").alias("n")).where("n > 1").drop("n")  # a box ties its cells
    ties = covered.join(wide, [*by, key]).where("cx <> c.cx OR cy <> c.cy").select(*cell, F.col("c.cx").alias("tx"), F.col("c.cy").alias("ty"))
    links = links.union(ties)
    both = written(links.union(links.select(*by, "tx", "ty", F.col("cx").alias("tx2"), F.col("cy").alias("ty2"))).distinct())
    labels = written(ends.select(*cell, "label"))
    while True:
        near = both.join(labels, cell).groupBy(*by, F.col("tx").alias("cx"), F.col("ty").alias("cy")).agg(F.min("label").alias("near"))
        step = labels.join(near, cell, "left").select(*cell, F.least("label", "near").alias("new"), "label")
        # a cell also takes what the cells of its label have come to: labels spread by doubling steps
        root = step.groupBy(*by, "label").agg(F.min("new").alias("root"))
        new = written(step.join(root, [*by, "label"]).select(*cell, F.least("new", "root").alias("label"), (F.least("new", "root") < F.col("label")).alias("changed")))
        moved = new.where("changed").limit(1).count()
        labels = new.drop("changed")
        if not moved:
            break
    return covered.join(labels, cell).groupBy(*by, key).agg(F.min("label").alias("cluster"))
