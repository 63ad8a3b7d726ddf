"""Numbering, running comparisons, draws and shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], *order: Column, name: str = "seq", start: int = 1) -> DataFrame:
    """Continuous numbers in each group. For groups that one task can sort; ``numbered_in_ranges`` is for larger ones."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("int"))


def numbered_in_ranges(df: DataFrame, by: list[str], range_column: str, width: int, *order: Column, name: str = "seq") -> DataFrame:
    """As ``numbered`` where ``range_column`` (a number) leads the order: rows are numbered within ranges of ``width``
    and the counts of the ranges before are added, so that a very large group is sorted by many tasks."""
    df = df.withColumn("__r", F.floor(F.col(range_column) / width))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by, "__r").agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    match = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "__r"]])
    out = df.alias("d").join(offsets.alias("o"), match).select("d.*", "o.__o")
    return out.withColumn(name, (F.row_number().over(Window.partitionBy(*by, "__r").orderBy(*order)) + F.col("__o")).cast("long")).drop("__r", "__o")


def appended(new: DataFrame, existing: DataFrame, by: str, *order: Column) -> DataFrame:
    """New lines get positions after the last one of their group, in this order; a group without lines starts at 0."""
    last = existing.groupBy(F.col(by).alias("__g")).agg(F.max("position").alias("__last"))
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return new.join(last, F.col(by) == F.col("__g"), "left").withColumn("position", (F.coalesce("__last", F.lit(-1)) + at).cast("long")).drop("__g", "__last")


def roll_numbers(students: DataFrame, by: str, prefix: Column, *order: Column) -> DataFrame:
    """Give numbers to students of a class that lack one: prefix and a count of two digits at least, after those who have one."""
    lacking = F.col("roll_no").isNull()
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.sum(lacking.cast("int")).over(w)
    n = F.count_if(~lacking).over(Window.partitionBy(by)) + k
    digits = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))  # lpad would cut longer ones
    return students.withColumn("roll_no", F.when(lacking, F.concat(prefix, digits)).otherwise(F.col("roll_no")))


def gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """(by, missing, previous, next): numbers between a group's smallest and largest that it lacks, with their neighbours.

    Only stretches between neighbouring numbers are expanded, so a gap's row count is what is missing.
    """
    have = df.where(F.col(number).isNotNull()).select(by, F.col(number).cast("long").alias("n")).distinct()
    pairs = have.withColumn("next", F.lead("n").over(Window.partitionBy(by).orderBy("n"))).where(F.col("next") > F.col("n") + 1)
    return pairs.select(by, F.explode(F.sequence(F.col("n") + 1, F.col("next") - 1)).alias("missing"), F.col("n").alias("previous"), "next")


def rising(df: DataFrame, by: str, number: str, *order: Column) -> DataFrame:
    """Rows whose number exceeds all before them in their group; rows without a number stay."""
    before = F.max(number).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__b", before).where(F.col(number).isNull() | F.col("__b").isNull() | (F.col(number) > F.col("__b"))).drop("__b")


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in this order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def until_marker(df: DataFrame, by: str, marker: Column, *order: Column, name: str = "after_marker") -> DataFrame:
    """Add whether an earlier row of the group is a marker."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(marker.cast("int")).over(w) == 1, F.lit(False)))


def draw(questions: DataFrame, rules: list[tuple[Column, int]], seed: int) -> DataFrame:
    """Questions drawn at random for each rule (condition, count) in turn, without replacement: the columns of ``questions``,
    and rule and place (from 0).

    The order is a hash of seed and id. Earlier rules can take no more questions from a rule than they draw in all, so
    one pass keeps for each rule as many of its first as all rules up to it draw; tasks keep so many before they are
    merged. The draw itself, rule after rule, then runs over these few alone. A null id takes no part, a null
    condition is false, rows that repeat an id count once.
    """
    wanted = [(i, c, n) for i, (c, n) in enumerate(rules) if n >= 1]
    if not wanted:
        return questions.limit(0).withColumns({"rule": F.lit(0), "place": F.lit(0)})
    up_to = {i: sum(n for k, _, n in wanted if k <= i) for i, _, _ in wanted}
    item = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))).alias("h"), F.col("id").alias("id"), F.struct(*questions.columns).alias("row"))
    fits = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c, _ in wanted]))
    hits = questions.where("id IS NOT NULL").select(item.alias("q"), fits.alias("rules")).select("q", F.explode("rules").alias("rule"))
    first = Window.partitionBy("rule").orderBy("q.h", "q.id")
    # rank, not row_number: rows that repeat an id stand together and are made one before they are counted
    few = hits.withColumn("__k", F.dense_rank().over(first)).where(reduce(lambda a, b: a | b, [(F.col("rule") == i) & (F.col("__k") <= n) for i, n in up_to.items()]) & (F.col("__k") <= max(up_to.values())))
    few = few.groupBy("rule", "q.h", "q.id").agg(F.min("q.row").alias("row"))
    lists = few.groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("rule") == i, F.struct("h", "id", "row")))).alias(f"r{i}") for i, _, _ in wanted])
    placed = lambda i: lambda q, k: F.struct(F.lit(i).alias("rule"), k.alias("place"), q["row"].alias("row"))
    taken, drawn = F.array().cast(f"array<{questions.schema['id'].dataType.simpleString()}>"), []
    for i, _, n in wanted:
        lists = lists.withColumn("taken", taken).withColumn(f"d{i}", F.slice(F.filter(f"r{i}", lambda q: ~F.array_contains("taken", q["id"])), 1, n))
        taken = F.concat("taken", F.transform(f"d{i}", lambda q: q["id"]))
        drawn.append(F.transform(f"d{i}", placed(i)))
    return lists.select(F.explode(F.concat(*drawn)).alias("d")).select("d.row.*", "d.rule", "d.place")


def seeded_order(df: DataFrame, by: str, seed: Column, item: str, name: str = "place") -> DataFrame:
    """A shuffle of each group's items that a seed fixes: places from 0 in order of a hash of seed and item."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", seed.cast("string"), F.col(item).cast("string"))), item)) - 1).cast("int"))


_64, _32 = (1 << 64) - 1, (1 << 32) - 1


def fisher_yates(items: list, seed: int) -> list:
    """Items in an order that a 64-bit seed fixes: swaps from the last place down, drawn from the lower half of an
    xorshift generator (left 13, right 7, left 17). A seed of 0 counts as 1, a negative one as its two's complement."""
    out, s = list(items), seed or 1
    for last in range(len(out) - 1, 0, -1):
        s = (s ^ (s << 13)) & _64
        s ^= s >> 7
        s = (s ^ (s << 17)) & _64
        at = (s & _32) % (last + 1)
        out[last], out[at] = out[at], out[last]
    return out


def seeded_shuffle(df: DataFrame, items: str, seed: str, name: str = "shuffled") -> DataFrame:
    """Add an array column's items in the order that ``fisher_yates`` gives them with the row's seed (null: 1)."""
    kind = df.schema[items].dataType

    @F.pandas_udf(kind)
    def run(values, seeds):
        import pandas as pd

        return pd.Series([None if v is None else fisher_yates(list(v), 1 if pd.isna(s) else int(s)) for v, s in zip(values, seeds)])

    return df.withColumn(name, run(F.col(items), F.col(seed)))


def unseeded_shuffle(df: DataFrame, items: str, name: str = "shuffled") -> DataFrame:
    return df.withColumn(name, F.shuffle(items))


def tagged(first: DataFrame, second: DataFrame, tags: tuple[str, str]) -> DataFrame:
    """Two lists, one after the other, with a column that says which."""
    return first.withColumn("list", F.lit(tags[0])).unionByName(second.withColumn("list", F.lit(tags[1])))


def repeats_by_agreement(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Keys that occur more than once, and whether their values agree."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(value).alias("kinds"))
    return g.where("n > 1").select(*by, "n", F.when(F.col("kinds") > 1, "conflict").otherwise("identical").alias("state"))
