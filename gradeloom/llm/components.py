"""Connected components of a link table, by alternating star contractions as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import cut, fitted


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a long, b long) -> (node long, root long) for every node that has a link.

    ``root`` is the smallest node that can be reached. Each round replaces a node's links to larger
    neighbours by links to its smallest neighbour (large star), then does so for smaller neighbours (small
    star), until every link points at its root. A round's minima are written before they are joined, so the
    join's exchange is its own and Spark can split a node with very many neighbours; each round's links go to
    the checkpoint folder, in as many tasks as they are worth.
    Null ends and self links are ignored; no links give an empty result.
    """
    e = cut(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct()
    )

    def measure(x):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = measure(e)
    if not before[0]:
        return e.selectExpr("u AS node", "v AS root")
    for _ in range(most_rounds):
        rows = 2 * before[0]  # no table of a round has more
        e = fitted(e, rows)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(fitted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(fitted(fitted(large, rows).distinct(), rows))
        small_least = cut(fitted(large.groupBy("u").agg(F.min("v").alias("m")), rows))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
        )
        e = cut(fitted(fitted(small, rows).distinct(), rows))
        after = measure(e)
        if after == before:
            return fitted(e.selectExpr("u AS node", "v AS root").union(e.selectExpr("v AS node", "v AS root").distinct()), rows)
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
