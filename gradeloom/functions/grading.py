"""Grading of answers by question type, as native column expressions.

A question row has type, key (JSON), marks and negative_marks; an answer is a JSON payload. The result is
is_correct (null for questions that people grade) and marks_awarded. A blank answer is wrong and costs nothing;
a wrong one, one of the wrong JSON type included, costs the negative marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEGATIVE, BLANK, RIGHT, PENDING = "wrong", "blank", "right", "pending"


def text_at(payload: Column, path: str) -> Column:
    """A string at a path of a variant; null where there is none or where it isn't a string."""
    v = F.try_variant_get(payload, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def strings_at(payload: Column, path: str) -> Column:
    """The strings of an array at a path of a variant; other members are dropped, and null is no array."""
    items = F.try_variant_get(payload, path, "array<variant>")
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def is_blank(payload: Column) -> Column:
    """Null, and objects or arrays without members."""
    return payload.isNull() | F.regexp_replace(payload, r"\s+", "").isin("{}", "[]", "null")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def grade(df: DataFrame, kind: str = "type", key: str = "key", answer: str = "answer_payload") -> DataFrame:
    """Add is_correct and marks_awarded. Keys by type: SINGLE_CHOICE, VISUAL and MULTIPLE_CHOICE {correct: [ids]},
    TRUE_FALSE {correct}, FILL_BLANK {accepted, caseSensitive}, MATCH_FOLLOWING {pairs: [{left, right}]},
    MATRIX_MATCH {correctMap: {row: [cols]}}, DESCRIPTIVE nothing. An unknown type is an error."""
    # each payload is parsed once, into a column of its own
    columns = [c for c in df.columns if c not in ("is_correct", "marks_awarded")]
    df = df.withColumns({"__k": F.try_parse_json(key), "__a": F.try_parse_json(answer)})
    t, k, a = F.col(kind), F.col("__k"), F.col("__a")
    single = F.coalesce(F.array_contains(strings_at(k, "$.correct"), text_at(a, "$.selectedOptionId")), F.lit(False))
    multiple = F.coalesce(same_set(strings_at(k, "$.correct"), strings_at(a, "$.selectedOptionIds")), F.lit(False))
    boolean = lambda c, path: F.try_variant_get(c, path, "variant")
    truth = lambda c, path: F.when(F.schema_of_variant(boolean(c, path)) == "BOOLEAN", F.try_variant_get(boolean(c, path), "$", "boolean"))
    true_false = F.coalesce(truth(k, "$.correct") == truth(a, "$.answer"), F.lit(False))
    exact = F.coalesce(truth(k, "$.caseSensitive"), F.lit(False))
    fold = lambda c: F.when(exact, trimmed(c)).otherwise(F.lower(trimmed(c)))
    given = fold(text_at(a, "$.text"))
    fill = F.coalesce(F.exists(strings_at(k, "$.accepted"), lambda x: fold(x) == given), F.lit(False))
    pair = "array<struct<left:string,right:string>>"
    pairs = F.try_variant_get(k, "$.pairs", pair)
    matches = F.try_variant_get(a, "$.matches", pair)
    # of equal lefts in the key the last one counts; lengths are compared, so a pair given twice stands for two
    last = lambda left: F.element_at(F.filter(pairs, lambda p: p["left"] == left), -1)["right"]
    match = F.coalesce((F.size(matches) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["left"])))) & F.forall(matches, lambda m: F.coalesce(last(m["left"]) == m["right"], F.lit(False))), F.lit(False))
    rows = "map<string,array<string>>"
    want = F.try_variant_get(k, "$.correctMap", rows)
    got = F.try_variant_get(a, "$.selections", rows)
    matrix = F.coalesce(
        (F.size(want) == F.size(got))
        & F.forall(F.map_keys(want), lambda r: F.coalesce((F.size(F.element_at(got, r)) == F.size(F.array_distinct(F.element_at(want, r)))) & F.forall(F.element_at(got, r), lambda c: F.array_contains(F.element_at(want, r), c)), F.lit(False))),
        F.lit(False),
    )
    right = (
        F.when(t.isin("SINGLE_CHOICE", "VISUAL"), single)
        .when(t == "MULTIPLE_CHOICE", multiple)
        .when(t == "TRUE_FALSE", true_false)
        .when(t == "FILL_BLANK", fill)
        .when(t == "MATCH_FOLLOWING", match)
        .when(t == "MATRIX_MATCH", matrix)
        .otherwise(F.raise_error(F.concat(F.lit("unknown question type "), F.coalesce(t, F.lit("null")))).cast("boolean"))
    )
    df = df.withColumn("__blank", is_blank(F.col(answer))).withColumn("__right", F.when(~F.col("__blank") & ~t.eqNullSafe(F.lit("DESCRIPTIVE")), right))
    right, blank = F.col("__right"), F.col("__blank")
    correct = F.when(t == "DESCRIPTIVE", F.lit(None).cast("boolean")).otherwise(~blank & right)
    marks = F.when((t == "DESCRIPTIVE") | blank, F.lit(0)).when(right, F.col("marks")).otherwise(-F.col("negative_marks"))
    return df.select(*columns, correct.alias("is_correct"), marks.cast("decimal(7,2)").alias("marks_awarded"))
