"""Quality: naive Bayes support vectors over indicators of n-grams.

An n-gram's indicator is scaled by its class log-count ratio, and a linear model with hinge loss is fitted on
the scaled indicators by dual coordinate descent. Grams are taken of three sequences of a text: its signs
(letters and digits drawn together, other signs kept, capitals apart), how far back each word was last seen,
and its words. An n-gram of the first two has one indicator for each share of the text that it reaches, so
that a stray sign is not taken for a text that is full of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import Shipped, cut
from gradeloom.llm.mixing import hashed_unit

#: Labelled rows that the classifier is fitted on, at most (in expectation: rows are chosen by a hash of doc_id).
MOST_LABELLED = 12_000
#: Grams of signs and of distances have up to so many members, and an indicator for each of these shares that they reach.
SIGNS, DISTANCES = 4, 3
SHARES = (0.0, 0.02, 0.08, 0.25)
#: Words as far apart as this are not told from new ones.
FARTHEST = 4
#: Labelled documents that an indicator needs.
LEAST_DOCS = 3
#: Added to each count; the loss's weight (divided among the classes so that both weigh the same); share of the mean
#: weight in every weight (naive Bayes) against the fitted one.
SMOOTH, LOSS, BAYES = 1.0, 1.0, 0.25
THRESHOLD = 0.7

#: What a byte becomes: 1 small letters and all beyond ASCII, 2 capitals, 3 digits, 4 blanks, 5 line ends, 6 control signs, from 7 on each sign of its own.
KIND = np.array([1 if c >= 128 or 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (9, 32) else 5 if 10 <= c <= 13 else 6 if c < 32 or c == 127 else 7 + c - 33 for c in range(256)], np.uint8)


def runs(kinds: np.ndarray) -> np.ndarray:
    """Runs of one kind as one member: kind * 4 + length up to 3; letters, digits and blanks have no length, capitals one or more."""
    if not len(kinds):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    kind, length = kinds[at].astype(np.int64), np.minimum(np.diff(np.append(at, len(kinds))), 3)
    length = np.where(kind == 2, np.minimum(length, 2), np.where((kind == 1) | (kind == 3) | (kind == 4), 0, length))
    return kind * 4 + length


def distances(ids: np.ndarray) -> np.ndarray:
    """How many words back each word was last seen: 1 to ``FARTHEST``, else 0."""
    out = np.zeros(len(ids), np.int64)
    for d in range(FARTHEST, 0, -1):
        out[d:][ids[d:] == ids[:-d]] = d
    return out


def grams(x: np.ndarray, most: int, base: int, first: int) -> np.ndarray:
    """Indicators of the sequence's n-grams: 64-bit codes of (n, gram, share reached)."""
    out = []
    code = np.zeros(len(x), np.int64)
    for n in range(1, most + 1):
        if len(x) < n:
            break
        code = code[: len(x) - n + 1] * base + x[n - 1 :] if n > 1 else x.copy()
        found, counts = np.unique(code, return_counts=True)
        reached = counts / len(code)
        for i, share in enumerate(SHARES):
            out.append((found[reached >= share] * 8 + i) * 16 + first + n)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.lower().split() if w]


def indicators(text: bytes | None) -> np.ndarray:
    """Different codes of a whole text's indicators, in order."""
    if not text:
        return np.zeros(0, np.int64)
    signs = runs(KIND[np.frombuffer(text, np.uint8)])
    words = words_of(text)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) & ~15 for w in number), np.uint64, len(number)).view(np.int64)
    return np.unique(np.concatenate([grams(signs, SIGNS, 512, 0), grams(distances(ids), DISTANCES, 8, 8), hashed]))


class Model:
    """Indicators with their weights, a constant, and the sigmoid from margins to scores."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, constant: float, sigmoid: tuple[float, float]):
        self.codes, self.weights, self.constant, self.sigmoid = codes, weights, constant, sigmoid

    def margin(self, found: np.ndarray) -> float:
        if not len(self.codes) or not len(found):
            return self.constant
        at = np.searchsorted(self.codes, found)
        at[at == len(self.codes)] = 0
        return self.constant + float(self.weights[at[self.codes[at] == found]].sum())

    def score(self, text: bytes | None) -> float:
        a, b = self.sigmoid
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(indicators(text)) + b, -40, 40))))


def ratios(good: np.ndarray, bad: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Class log-count ratios of indicators: good and bad documents that have each."""
    p, q = good + smooth, bad + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bounds: np.ndarray, size: int, rounds: int = 60, close: float = 0.02) -> np.ndarray:
    """Weights (the last is the constant) of the linear model with hinge loss, by dual coordinate descent.

    ``rows`` are (places, values), ``bounds`` the largest dual value of each row. Rows are visited in an order
    that a fixed seed shuffles; descent ends when no projected gradient of a round exceeds ``close``.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1
            if alpha[i] <= 0:
                g = min(g, 0.0)
            elif alpha[i] >= bounds[i]:
                g = max(g, 0.0)
            worst = max(worst, abs(g))
            if g:
                new = min(max(alpha[i] - g / squares[i], 0.0), bounds[i])
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
        if worst < close:
            break
    return w


def fit_rows(places: list[np.ndarray], y: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of indicators (log-count ratios times fitted weights) and the constant. ``y`` is 1 or -1."""
    r = ratios(good, bad)
    n_good, n_bad = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    bounds = LOSS * len(y) / 2 * np.where(y > 0, 1 / n_good, 1 / n_bad)
    scale = 1 / np.sqrt(max(1.0, np.mean([float((r[p] ** 2).sum()) for p in places])))  # rows of length 1 on average
    w = dual_descent([(p, r[p] * scale) for p in places], y, bounds, len(r))
    mean = np.abs(w[:-1]).mean() if len(r) else 0.0
    return ((1 - BAYES) * w[:-1] + BAYES * mean) * r * scale, float(w[-1])


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))), by Newton's method on targets drawn in a little from 0 and 1."""
    n_good, n_bad = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), x.T @ (t - p) - 1e-4 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on labelled rows outside the held-out fold, about ``most_labelled`` of them at most (chosen by a hash of doc_id).

    Rows with a null id or a label other than 0 and 1 are left out; of an id's labels, and of a text's, the
    largest counts. Without labelled rows, or without a class, every score is the share of good rows (0.5 without rows).
    Indicators are counted by Spark; the bounded sample is fitted on the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > most_labelled:
        known = known.where(hashed_unit(F.lit("quality"), "doc_id") < F.lit(most_labelled / n))
    known = cut(known.select("doc_id", F.col("quality").cast("int").alias("quality")))
    chosen = F.broadcast(known) if known.count() <= 2 * most_labelled else known
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id").groupBy("text").agg(F.max("quality").alias("quality"))

    def run(batches):
        for b in batches:
            found = [indicators(t.as_py()) for t in b.column("text")]
            ids = [xxhash.xxh64_intdigest(t.as_py()) >> 1 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("quality"), pa.array(found, pa.list_(pa.int64()))], ["id", "quality", "codes"])

    sample = cut(texts.mapInArrow(run, "id long, quality int, codes array<long>"))
    counts = sample.select("quality", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    counted = counts.where(F.col("n") >= LEAST_DOCS).toArrow().sort_by("code")
    codes, good, n = (counted[c].to_numpy() for c in ("code", "good", "n"))
    good, bad = good.astype(float), (n - good).astype(float)
    kept = Shipped(docs.sparkSession, codes)  # of the bounded sample

    def numbered(batches):
        codes = kept.get()
        for b in batches:
            found = [np.flatnonzero(np.isin(codes, c.values.to_numpy(), assume_unique=True)).astype(np.int32).tobytes() for c in b.column("codes")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality"), pa.array(found, pa.binary())], ["id", "quality", "places"])

    rows = sample.mapInArrow(numbered, "id long, quality int, places binary").toArrow().sort_by("id")
    y = np.where(rows["quality"].to_numpy() > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model(codes[:0], np.zeros(0), 0.0, (1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))))
    places = [np.frombuffer(p.as_py(), np.int32) for p in rows["places"]]
    weights, constant = fit_rows(places, y, good, bad)
    # margins of rows that the model has not seen: three folds
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        out = fold == k
        own, y_own = [places[i] for i in np.flatnonzero(~out)], y[~out]
        if (y_own > 0).all() or (y_own < 0).all():
            w, c = weights, constant
        else:
            of = lambda side: np.bincount(np.concatenate([places[i] for i in np.flatnonzero(out & side)] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=len(codes))
            w, c = fit_rows(own, y_own, good - of(y > 0), bad - of(y < 0))
        for i in np.flatnonzero(out):
            margins[i] = c + w[places[i]].sum()
    return Model(codes, weights, constant, sigmoid(margins, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (0 or 1) to ``docs`` (text; other columns stay, these two are replaced).

    Each whole text is scored on its own. Null and empty texts have no indicators and get the score of the
    model's constant. Repeated rows get equal scores; an empty table gives an empty result.
    """
    kept = docs.drop("score", "predicted")
    box = Shipped(docs.sparkSession, model)  # as many indicators as the bounded sample has

    def run(batches):
        model = box.get()
        for b in batches:
            s = np.array([model.score(None if not t.is_valid else t.as_buffer().to_pybytes()) for t in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
