"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import cut, partitions

#: Distribution tables up to this number of doubles in all (32 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_DOUBLES = 4_000_000
#: Repeated (doc_id, text) pairs up to this number are broadcast (48 bytes each); more are joined by a shuffle.
BROADCAST_REPEATS = 200_000


def hashed_unit(*parts):
    """A number in (0, 1) that depends on the parts alone: 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def hashed_long(*parts):
    hexed = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def repetition_rates(docs: DataFrame, weights: dict | None = None, temperature_half: bool = True) -> DataFrame:
    """(source, size, rate): the mean number of times that each source's documents have to be repeated.

    ``weights`` gives target shares of the mixture by source, of 1 in all; what the listed ones leave is dealt
    among the other sources by the square root of their size (or their size, without ``temperature_half``).
    Shares that add up to 1 or more leave the others nothing; they are then taken relative to their sum.
    Square roots are held as whole millionths, so that their sum doesn't depend on the order of addition. The
    mixture is as large as the input: rate = share x all characters / characters of the source. A source
    without characters has rate 1; a listed source keeps its share however small it is.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    natural = F.sqrt(F.col("size").cast("double")) if temperature_half else F.col("size").cast("double")
    if any(not w >= 0 for w in (weights or {}).values()):
        raise ValueError("a target share is a number from 0 on")
    given = F.lit(None).cast("double")
    for name, w in (weights or {}).items():
        given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(given)
    sizes = sizes.withColumn("given", F.when(F.col("size") > 0, given)).withColumn("w", F.when(F.col("given").isNull(), F.floor(natural * F.lit(1e6)).cast("long")).otherwise(F.lit(0)))
    sums = sizes.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_size"), F.coalesce(F.sum(F.col("given").cast("decimal(38,18)")).cast("double"), F.lit(0.0)).alias("all_given"))
    rest = F.greatest(F.lit(0.0), 1.0 - F.col("all_given"))
    own = F.try_divide("given", F.when(F.col("all_w") == 0, F.col("all_given")).otherwise(F.greatest(F.lit(1.0), F.col("all_given"))))
    share = F.coalesce(own, F.try_divide(F.col("w").cast("double"), F.col("all_w").cast("double")) * rest)
    rate = F.when((F.col("size") == 0) | share.isNull(), F.lit(1.0)).otherwise(share * (F.col("all_size").cast("double") / F.col("size").cast("double")))
    return sizes.crossJoin(F.broadcast(sums)).select("source", "size", rate.alias("rate"))  # sums is one row


def with_poisson_table(rates: DataFrame) -> DataFrame:
    """Add (first, cdf): the Poisson distribution function from ``first`` on, as far as doubles can tell it from 0 and 1."""
    lam = F.col("rate")
    first = F.greatest(F.lit(0), F.floor(lam - 12 * F.sqrt(lam) - 40)).cast("long")
    last = F.ceil(lam + 12 * F.sqrt(lam) + 40).cast("long")
    x = F.col("first").cast("double") + 1
    # Stirling's series for ln(first!), used for large rates only, where it is exact to the last digits
    ln_fact = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x)
    at_first = F.when(F.col("first") == 0, F.exp(-lam)).otherwise(F.exp(F.col("first") * F.log(lam) - lam - ln_fact))
    zero = F.struct(F.col("p0").alias("p"), F.array(F.col("p0")).alias("c"))
    step = lambda a, k: F.struct(
        (a["p"] * F.col("rate") / k.cast("double")).alias("p"),
        F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * F.col("rate") / k.cast("double"))).alias("c"),
    )
    return (
        rates.withColumn("first", first)
        .withColumn("last", last)
        .withColumn("p0", at_first)
        .withColumn("cdf", F.aggregate(F.sequence(F.col("first") + 1, "last"), zero, step)["c"])
        .drop("p0", "last")
    )


def poisson_mix(docs: DataFrame, weights: dict | None = None, temperature_half: bool = True, seed: int = 17) -> DataFrame:
    """Repeat or drop documents so that sources take their target shares, and shuffle the result globally.

    ``docs`` needs doc_id, text and source; other columns stay. Each row gets a Poisson count with its
    source's mean repetition rate, by inverting the distribution function at a number hashed from ``seed``,
    doc_id and text, and is exploded into that many rows. Rows that repeat a (doc_id, text) also hash their
    place in the input, so each has a draw of its own; only these draws depend on how the input is laid out. Added columns: copy (1..n_copies), n_copies,
    shuffle_key; columns of these names in the input are replaced. Rows are dealt to partitions by
    shuffle_key, a hash of what the count is drawn from and of copy, and sorted by it there: a global shuffle in one exchange.

    Nulls: a null source is a source of its own, a null text has no characters, a null doc_id hashes as the
    empty string. An empty table gives an empty result.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    rates = cut(with_poisson_table(repetition_rates(docs, weights, temperature_half)).selectExpr("source AS __mix_source", "rate AS __mix_rate", "first AS __mix_first", "cdf AS __mix_cdf"))
    few = (rates.agg(F.sum(F.size("__mix_cdf"))).first()[0] or 0) <= BROADCAST_DOUBLES
    marked = docs.withColumn("__mix_text", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    key = F.struct(F.col("doc_id"), F.col("__mix_text"))
    repeats = cut(marked.select("doc_id", "__mix_text").groupBy(key.alias("__mix_key")).agg(F.count("*").alias("n")).where("n > 1").select("__mix_key"))
    n_repeats = repeats.count()
    if n_repeats:
        repeats = repeats.withColumn("__mix_again", F.lit(True))
        marked = marked.join(F.broadcast(repeats) if n_repeats <= BROADCAST_REPEATS else repeats, key.eqNullSafe(F.col("__mix_key")), "left")
        marked = marked.withColumn("__mix_place", F.monotonically_increasing_id()).withColumn("__mix_place", F.when(F.col("__mix_again"), F.col("__mix_place")))
    else:
        marked = marked.withColumn("__mix_place", F.lit(None).cast("long"))
    drawn = ["doc_id", "__mix_text", "__mix_place"]
    joined = marked.join(F.broadcast(rates) if few else rates, marked["source"].eqNullSafe(F.col("__mix_source")))
    u = hashed_unit(F.lit(str(seed)), *drawn)
    n = (F.col("__mix_first") + F.size(F.filter("__mix_cdf", lambda c: c < F.col("__mix_u")))).cast("int")
    out = (
        joined.withColumn("__mix_u", u)
        .withColumn("n_copies", n)
        .where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", hashed_long(F.lit(f"{seed}:order"), *drawn, "copy"))
    )
    return (
        out.select(*docs.columns, "copy", "n_copies", "shuffle_key")
        .repartition(partitions(docs.sparkSession), "shuffle_key")
        .sortWithinPartitions("shuffle_key", "doc_id", "copy")
    )


MIX_SQL = """
WITH s AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1e6) AS BIGINT) AS w FROM s),
t AS (SELECT CAST(sum(w) AS DOUBLE) AS all_w, CAST(sum(size) AS DOUBLE) AS all_size FROM w),
r AS (SELECT source, CASE WHEN size = 0 OR all_w = 0 THEN 1.0 ELSE (CAST(w AS DOUBLE) / all_w) * (all_size / CAST(size AS DOUBLE)) END AS rate FROM w, t),
k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM r),
p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
c AS (SELECT source, list(cdf) AS cdf FROM p GROUP BY source),
u AS (SELECT d.*, (CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':'), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents d),
n AS (SELECT u.*, CAST(len(list_filter(c.cdf, lambda x: x < u.u)) AS INTEGER) AS n_copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source),
e AS (SELECT n.*, unnest(generate_series(1, n_copies)) AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, n_copies,
  CAST(('0x' || substr(md5('17:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || '::' || CAST(copy AS VARCHAR)), 1, 15)) AS BIGINT) AS shuffle_key
FROM e
"""
