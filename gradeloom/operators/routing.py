"""Which pages a slower reader should see: signals, votes and their calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.analytics import rounded


@dataclass(frozen=True)
class Routing:
    """Limits of the votes and their weights."""

    confidence: float = 0.7
    low_word: float = 60
    low_ratio: float = 0.35
    median: float = 65
    chars: float = 80
    empty_chars: float = 15
    noise: float = 0.25
    nondict: float = 0.55
    least_words: int = 8
    threshold: float = 0.5
    weights: tuple = (0.3, 0.2, 0.15, 0.15, 0.1, 0.1)
    hint_bias: float = 0.1
    scan_bias: float = 0.1
    machine_chars: float = 100
    scan_chars: float = 10
    hard_hint: bool = False
    hints: tuple = ("answer-sheet", "answersheet", "/answers/", "handwritten", "/scripts/", "/submissions/")


DEFAULT = Routing()


def word_stats(words: DataFrame, *keys: str, low: float = DEFAULT.low_word) -> DataFrame:
    """(keys, words, median, low_ratio) of words (conf 0..100): exact median, share below ``low``."""
    return words.groupBy(*keys).agg(F.count("conf").alias("words"), F.median("conf").alias("median"), (F.count_if(F.col("conf") < low).cast("double") / F.count("conf")).alias("low_ratio"))


def noise_ratio(text: Column) -> Column:
    """Share of characters, white space aside, that are no letters, digits or common marks; 0 without any."""
    solid = F.regexp_replace(text, r"\s+", "")
    bad = F.length(F.regexp_replace(solid, r"[a-zA-Z0-9.,;:?!'\"()\-/%$=+]", ""))
    return F.when(F.length(solid) > 0, bad.cast("double") / F.length(solid)).otherwise(0.0)


def nondict_ratio(text: Column) -> Column:
    """Share of words of two letters or more that have no vowel or a letter three times running; 0 without any."""
    low = F.lower(text)
    tokens, bad = F.regexp_count(low, F.lit("[a-z]{2,}")), F.regexp_count(low, F.lit(r"(?<![a-z])(?:[b-df-hj-np-tv-z]{2,}(?![a-z])|[a-z]*?([a-z])\1\1[a-z]*)"))
    return F.when(tokens > 0, bad.cast("double") / tokens).otherwise(0.0)


def pre_route(df: DataFrame, r: Routing = DEFAULT) -> DataFrame:
    """Add hint and verdict to files (storage_key, mime, layer_chars a page): only a PDF with a known text layer is judged."""
    hint = F.lit(False)
    for h in r.hints:
        hint = hint | F.contains(F.lower("storage_key"), F.lit(h))
    known = (F.col("mime") == "application/pdf") & F.col("layer_chars").isNotNull()
    verdict = F.when(known & (F.col("layer_chars") >= r.machine_chars), "MACHINE_TEXT").when(known & (F.col("layer_chars") < r.scan_chars), "SCAN_LIKELY").otherwise("INCONCLUSIVE")
    return df.withColumns({"hint": hint, "verdict": verdict})


def signals(df: DataFrame, r: Routing = DEFAULT) -> DataFrame:
    """Add chars_per_page, noise, nondict, near_empty to files (text, pages, sentinel)."""
    chars = F.length(F.coalesce("text", F.lit(""))).cast("double") / F.greatest(F.lit(1), F.col("pages"))
    return df.withColumns({"chars_per_page": chars, "noise": noise_ratio(F.coalesce("text", F.lit(""))), "nondict": nondict_ratio(F.coalesce("text", F.lit("")))}).withColumn("near_empty", F.col("sentinel") | (F.col("chars_per_page") < r.empty_chars))


def decide(df: DataFrame, r: Routing = DEFAULT) -> DataFrame:
    """Add route, score, reason to files with signals, words, median, low_ratio, confidence, hint and verdict."""
    vote = lambda c, w: F.when(c, w).otherwise(0.0)
    w = r.weights
    score = (
        vote(F.col("confidence") < r.confidence, w[0]) + vote(F.col("low_ratio") > r.low_ratio, w[1]) + vote(F.col("median") < r.median, w[2]) + vote(F.col("chars_per_page") < r.chars, w[3])
        + vote(F.col("noise") > r.noise, w[4]) + vote(F.col("nondict") > r.nondict, w[5]) + vote(F.col("hint"), r.hint_bias) + vote(F.col("verdict") == "SCAN_LIKELY", r.scan_bias)
    )
    df = df.withColumn("__s", score)
    small, unsure = F.coalesce("words", F.lit(0)) < r.least_words, F.col("confidence") < r.confidence
    reason = F.when(F.col("verdict") == "MACHINE_TEXT", "machine_text_force_node").when(F.col("near_empty"), "near_empty")
    if r.hard_hint:
        reason = reason.when(F.col("hint"), "answer_sheet_hint")
    reason = reason.when(small & unsure, "low_confidence_small_sample").when(small, "high_confidence_small_sample").when(F.col("__s") >= r.threshold, "score_threshold").otherwise("below_threshold")
    df = df.withColumn("reason", reason)
    route = F.col("reason").isin("near_empty", "answer_sheet_hint", "low_confidence_small_sample", "score_threshold")
    by_votes = F.col("reason").isin("score_threshold", "below_threshold")
    return df.withColumns({"route": route, "score": F.when(by_votes, F.least(F.lit(1.0), rounded(F.col("__s"), 2))).otherwise(route.cast("double"))}).drop("__s")


MARKER = "[ocr-routing] "


def read_log(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """Records of log lines (line): the JSON object behind the marker; other and malformed lines are left out, missing values are empty or 0."""
    at = F.instr("line", marker)
    json = F.trim(F.substr(F.col("line"), at + len(marker)))
    v = lines.where(at > 0).select(F.try_parse_json(json).alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    get = lambda name, kind, default: F.coalesce(F.try_variant_get("v", f"$.{name}", kind), F.lit(default)).alias(name)
    return v.select(get("storageKey", "string", ""), get("wouldRoute", "boolean", False), get("reason", "string", ""), get("score", "double", 0.0), get("confidence", "double", 0.0), get("words", "int", 0), get("preVerdict", "string", ""))


def summary(records: DataFrame) -> DataFrame:
    """(kind, value, n): the total and the routed ones, and counts by reason, verdict and score bucket; all five buckets are there."""
    bucket = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("score") * 5))).cast("int")
    base = records.select("reason", "verdict", bucket.cast("string").alias("bucket"), F.when(F.col("route"), "routed").otherwise("kept").alias("routed"))
    long = base.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("reason", "verdict", "bucket", "routed")])).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    frame = records.sparkSession.range(5).select(F.lit("bucket").alias("kind"), F.col("id").cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    return long.unionByName(frame).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def counters(records: DataFrame) -> DataFrame:
    """(total, routed, route_rate to three places)."""
    g = records.agg(F.count("*").alias("total"), F.count_if("route").alias("routed"))
    return g.withColumn("route_rate", F.when(F.col("total") > 0, rounded(F.col("routed").cast("double") / F.col("total"), 3)).otherwise(0.0))


def predicted(threshold: Column) -> Column:
    """Whether a record (reason, route, score) would be routed at a threshold: settled reasons keep their decision."""
    return (
        F.when(F.col("reason") == "machine_text_force_node", False)
        .when(F.col("reason").isin("near_empty", "answer_sheet_hint"), True)
        .when(F.col("reason").endswith("confidence_small_sample"), F.col("route"))
        .otherwise(F.col("score") >= threshold)
    )


def sweep(records: DataFrame, labels: DataFrame, steps: int = 20) -> DataFrame:
    """Confusion, precision, recall, F1 and accuracy at steps + 1 thresholds from 0 to 1; records without a label (key, handwritten) don't count.

    A record is routed at all thresholds up to some one, so records are counted by how many these are and only this
    histogram, of at most 2 (steps + 2) rows, is added up for each threshold.
    """
    routed = F.size(F.filter(F.sequence(F.lit(0), F.lit(steps)), lambda k: predicted(k / steps)))
    bins = records.join(labels, "key").groupBy(routed.alias("routed"), F.col("handwritten").alias("h")).agg(F.count("*").alias("n"))
    r = bins.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    said, true = F.col("routed") > F.col("k"), F.col("h")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = r.groupBy("k").agg(of(said & true).alias("tp"), of(said & ~true).alias("fp"), of(~said & ~true).alias("tn"), of(~said & true).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, c = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    g = g.withColumns({"p": p, "c": c})
    return g.select((F.col("k") / steps).alias("threshold"), "tp", "fp", "tn", "fn", rounded(F.col("p"), 3).alias("precision"), rounded(F.col("c"), 3).alias("recall"), rounded(ratio(2 * F.col("p") * F.col("c"), F.col("p") + F.col("c")), 3).alias("f1"), rounded(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), 3).alias("accuracy"))


def pick(swept: DataFrame, least_precision: float | None = None) -> DataFrame:
    """The threshold of the best F1, or with ``least_precision`` of the best recall among those that reach it; the lowest of equals."""
    if least_precision is None:
        return swept.orderBy(F.desc("f1"), "threshold").limit(1)
    return swept.where(F.col("precision") >= least_precision).orderBy(F.desc("recall"), "threshold").limit(1)
