"""Scans, predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, **key) -> DataFrame:
    """The rows whose columns have these values; None matches null."""
    for c, v in key.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df


def page_of(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in this order (end it with a unique key), with the total of all rows.

    The limit is held to 1..200. The total is counted apart and joined as one row, so no partition holds all.
    """
    limit = max(1, min(200, limit))
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(max(0, offset)).limit(limit).crossJoin(F.broadcast(total))


def role_scope(df: DataFrame, role: str, actor: int, branch: int | None = None) -> DataFrame:
    """What a person may see: a TEACHER's own rows (created_by), and only one branch if it is given."""
    if role == "TEACHER":
        df = df.where(F.col("created_by") == actor)
    return df if branch is None else df.where(F.col("branch_id") == branch)


def through_tenant(df: DataFrame, branches: DataFrame, tenant: int) -> DataFrame:
    """Rows whose branch belongs to a tenant."""
    own = branches.where(F.col("tenant_id") == tenant).select(F.col("id").alias("__branch"))
    return df.join(own, F.col("branch_id") == F.col("__branch"), "left_semi")


def contains_any(text: str, *columns: str) -> Column:
    """Case-insensitive, literal containment in one of these columns; a null column doesn't match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return out


def same_text(column: str, value: str | None) -> Column:
    """Case-insensitive equality; no value, or an empty one, matches null."""
    return F.col(column).isNull() if not value else F.lower(column) == F.lower(F.lit(value))


def with_presence(df: DataFrame, other: DataFrame, on: str, key: str, name: str) -> DataFrame:
    """Add whether ``other`` has a row whose ``on`` is this row's ``key``."""
    some = other.select(F.col(on).alias("__on")).distinct().withColumn("__some", F.lit(True))
    return df.join(some, F.col(key) == F.col("__on"), "left").withColumn(name, F.coalesce("__some", F.lit(False))).drop("__on", "__some")


def with_related(df: DataFrame, other: DataFrame, on: str, key: str = "id") -> DataFrame:
    """Rows that ``other`` refers to by ``on``."""
    return df.join(other.select(F.col(on).alias("__on")), F.col(key) == F.col("__on"), "left_semi")


def without_related(df: DataFrame, other: DataFrame, on: str, key: str = "id") -> DataFrame:
    """Rows that ``other`` doesn't refer to by ``on``. A null key is related to nothing, so it stays."""
    return df.join(other.select(F.col(on).alias("__on")), F.col(key) == F.col("__on"), "left_anti")


def overlay(defaults: dict, stored: Column) -> Column:
    """A map of settings: the defaults, each replaced by the stored JSON object's value where it has one."""
    return F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.coalesce(F.get_json_object(stored, f"$.{k}"), F.lit(str(v))))])


def sanitized(kind: Column, payload: Column) -> Column:
    """A question's payload as a student may see it, as JSON: its content, and by type the parts that don't tell the
    answer. Right sides of pairs are sorted, so that their order tells nothing. Values that are missing are null."""
    at = lambda name: F.get_json_object(payload, f"$.{name}")
    content = F.coalesce(at("contentHtml"), F.lit("")).alias("contentHtml")
    pairs = F.coalesce(F.from_json(at("pairs"), "array<struct<left:string,right:string>>"), F.array().cast("array<struct<left:string,right:string>>"))
    strings = lambda name: F.coalesce(F.from_json(at(name), "array<string>"), F.array().cast("array<string>")).alias(name)
    json = lambda *parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return (
        F.when(kind == "FILL_BLANK", json(content, F.coalesce(at("caseSensitive").cast("boolean"), F.lit(False)).alias("caseSensitive")))
        .when(kind == "MATCH_FOLLOWING", json(content, F.transform(pairs, lambda p: p["left"]).alias("lefts"), F.array_sort(F.transform(pairs, lambda p: p["right"])).alias("rights")))
        .when(kind == "MATRIX_MATCH", json(content, strings("rows"), strings("cols")))
        .when(kind == "DESCRIPTIVE", json(content, at("rubric").alias("rubric"), at("maxWords").cast("int").alias("maxWords")))
        .otherwise(json(content))
    )


def first_set(*columns: str) -> Column:
    """The first column that is set: explicit before assigned before default."""
    return F.coalesce(*columns)


def recommendation(subject: Column, topic: Column, percent: Column) -> Column:
    return F.format_string("Focus on %s (%s): currently at %s%%.", topic, subject, percent.cast("string"))


def rank_within(*by: Column, order: list[Column], name: str = "rank") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias(name)
