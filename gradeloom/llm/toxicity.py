"""Toxicity: Levenshtein automata intersected with a trie of a learnt lexicon, and context windows of hits."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Shipped, cut
from gradeloom.llm.mixing import hashed_unit

#: Words hold inner digits and masking signs ('id1ot', 'st*pid'), each in place of a letter.
WORD = re.compile(r"[^\W\d_]+(?:[\d_*@$#!+%&]{1,3}[^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled rows that the classifier is fitted on, at most (in expectation: rows are chosen by a hash of doc_id).
MOST_LABELLED = 12_000
#: A term needs so many toxic documents, so many times its share among the clean ones, and counts that chance gives so rarely.
LEAST_DOCS, LEAST_RATIO, MOST_CHANCE = 3, 25.0, 2e-3
#: A beginning of words also counts by the different words that begin so: in so many toxic documents, so many words a
#: document, so many times the share among clean ones, and counts that chance gives so rarely.
FEWER_DOCS, WORDS_A_DOC, WORDS_RATIO, WORDS_CHANCE = 2, 2.5, 10.0, 1e-5
#: Beginnings of words that count as terms of their own, by letters.
STEM_LENGTHS = (4, 12)
#: Terms from this length on also match with one letter wrong, missing or added.
FUZZY_FROM = 5
#: Words to either side of a hit that tell a quotation from abuse.
WINDOW = 6
THRESHOLD = 0.3
# Pairs of quotation marks. Marks that look alike on both sides pair within a line.
QUOTED = re.compile(r'"[^"\n]*"|[“„][^“„”]*[”“]|«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹')
FEATURES = ["any", "exact", "fuzzy", "stem", "quoted", "context", "share"]


class Lexicon:
    """Whole words and stems as one trie, walked together with Levenshtein automata of up to one error.

    A state is a set of (trie node, errors so far); states and their transitions are made when a word first
    needs them, so the walk of a word is one dictionary look-up a letter and ends at the first dead state.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy: list[str] | None = None, fuzzy_stems: list[str] | None = None):
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[bool] = [False]
        self.stem: list[bool] = [False]
        self.near: list[bool] = [False]  # some word below may be matched with an error
        fuzzy = [w for w in words if len(w) >= FUZZY_FROM] if fuzzy is None else fuzzy
        fuzzy_stems = [w for w in stems if len(w) >= FUZZY_FROM] if fuzzy_stems is None else fuzzy_stems
        for terms, mark in ((words, self.whole), (stems, self.stem)):
            for term in terms:
                s = 0
                for c in term:
                    if c not in self.next[s]:
                        self.next[s][c] = len(self.next)
                        self.next.append({})
                        for x in (self.whole, self.stem, self.near):
                            x.append(False)
                    s = self.next[s][c]
                mark[s] = True
        self.fuzzy_end, self.fuzzy_stem = [False] * len(self.next), [False] * len(self.next)
        for terms, mark in ((fuzzy, self.fuzzy_end), (fuzzy_stems, self.fuzzy_stem)):
            for w in terms:
                s, path = 0, [0]
                for c in w:
                    s = self.next[s][c]
                    path.append(s)
                mark[s] = True
                for s in path:
                    self.near[s] = True
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[str] = []  # what a word is that ends here
        self.start = self.state(self.closed({(0, 0)}))
        self.memo: dict[str, str] = {}

    def closed(self, items: set) -> frozenset:
        """Also what can be reached by leaving out a letter of a term."""
        for node, errors in list(items):
            if errors == 0 and self.near[node]:
                items |= {(n, 1) for n in self.next[node].values() if self.near[n]}
        return frozenset(items)

    def state(self, items: frozenset) -> int:
        if items not in self.ids:
            self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            # a word may also end one letter before the term does; that is in the closure
            exact = any(e == 0 and self.whole[n] for n, e in items)
            fuzzy = any(e == 1 and (self.fuzzy_end[n] or self.fuzzy_stem[n]) for n, e in items)
            stem = any(e == 0 and self.stem[n] for n, e in items)
            self.ends.append("exact" if exact else "stem" if stem else "fuzzy" if fuzzy else "")
        return self.ids[items]

    def move(self, state: int, c: str) -> int:
        items: set = set()
        for node, errors in self.sets[state]:
            if self.fuzzy_stem[node] if errors else self.stem[node]:
                items.add((node, errors))  # a stem is matched whatever follows
            if (n := self.next[node].get(c)) is not None and (errors == 0 or self.near[n]):
                items.add((n, errors))
            if errors == 0 and self.near[node]:
                items.add((node, 1))  # an added letter
                items |= {(n, 1) for n in self.next[node].values() if self.near[n]}  # a wrong letter
        self.moves[state][c] = to = self.state(self.closed(items)) if items else -1
        return to

    def match(self, word: str) -> str:
        """'exact', 'stem', 'fuzzy' or '' for a word in lower case."""
        s = self.start
        for c in word:
            t = self.moves[s].get(c)
            s = self.move(s, c) if t is None else t
            if s < 0:
                return ""
        return self.ends[s]

    def spans(self, text: str, hits: dict[str, str]):
        """(kind, start, end) of each hit of a text; a word with signs that is no hit itself is looked up in its parts."""
        for m in WORD.finditer(text):
            if kind := hits.get(m.group()):
                yield kind, m.start(), m.end()
            elif not m.group().isalpha():
                for part in LETTERS.finditer(text, m.start(), m.end()):
                    if kind := hits.get(part.group()):
                        yield kind, part.start(), part.end()

    def hits(self, words: set[str]) -> dict[str, str]:
        """The words that match, remembered for the next text of this task."""
        memo, out = self.memo, {}
        if len(memo) > 250_000:
            memo.clear()
        for w in words:
            m = memo.get(w)
            if m is None:
                m = memo[w] = self.match(w)
            if m:
                out[w] = m
        return out

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between paired quotation marks, over the whole text; a mark without a partner opens nothing."""
    return [m.span() for m in QUOTED.finditer(text)]


def context(text: str, at: int, to: int, spans: list[tuple[int, int]]) -> float | None:
    """How far a hit is embedded in a quotation: the share of the ``WINDOW`` words to either side of it that stand in
    the same one, whole words however long they are. None outside quotations."""
    i = bisect_right(spans, (at, len(text) + 1)) - 1
    if i < 0 or spans[i][1] < to:
        return None
    start, end = spans[i]
    before, after = text[start + 1 : at].split()[-WINDOW:], text[to : end - 1].split(maxsplit=WINDOW)[:WINDOW]
    return (len(before) + len(after)) / (2 * WINDOW)


def candidates(words: list[str]) -> set[str]:
    """The words, and the parts of those with signs."""
    out = set(words)
    return out.union(*(LETTERS.findall(w) for w in out if not w.isalpha()))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    low = (text or "").lower()
    words = WORD.findall(low)
    hits = lexicon.hits(candidates(words))
    if not hits:
        return [0.0] * len(FEATURES)
    n, inside, spans = Counter(), [], quotations(low)
    for kind, at, to in lexicon.spans(low, hits):
        embedded = context(low, at, to, spans) if spans else None
        if embedded is None:
            n[kind] += 1
        else:
            inside.append(embedded)
    free = sum(n.values())
    return [float(free > 0), *[float(np.log1p(n[k])) for k in ("exact", "fuzzy", "stem")], float(np.log1p(len(inside))), float(np.log1p(sum(inside))), float(np.log1p(100 * free / len(words)))]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], features(text, self.lexicon)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


#: Terms that a task holds counts of before it hands them on.
TERMS_HELD = 500_000
SPLIT = re.compile(r"[^\W\d_]{3,}")


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, whole, toxic, clean, toxic_words, clean_words): documents of the sample that hold a word, or a word
    that begins so, and how many different words a document these are, summed. Tasks add up before the shuffle."""

    def handed_on(held):
        terms, counts = list(held), np.array(list(held.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([w for _, w in terms], pa.bool_()), *(pa.array(c) for c in counts.T)], ["term", "whole", "toxic", "clean", "toxic_words", "clean_words"])

    def run(batches):
        held: dict = {}
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set(SPLIT.findall((text or "").lower()))
                begins = Counter(w[:k] for w in words for k in range(STEM_LENGTHS[0], min(STEM_LENGTHS[1], len(w)) + 1))
                side = 0 if toxic else 1
                for key, n in [*(((w, True), 1) for w in words), *(((t, False), n) for t, n in begins.items())]:
                    row = held.setdefault(key, [0, 0, 0, 0])
                    row[side] += 1
                    row[2 + side] += n
                if len(held) >= TERMS_HELD:
                    yield handed_on(held)
                    held = {}
        if held:
            yield handed_on(held)

    parts = sample.select("text", "toxic").mapInArrow(run, "term string, whole boolean, toxic long, clean long, toxic_words long, clean_words long")
    return parts.groupBy("term", "whole").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_words", "clean_words")])


def chance(toxic, clean, share: float):
    """A bound (Chernoff's) on how likely so many of a term's documents are toxic, if it tells nothing: ``share`` are anyway."""
    n = toxic + clean
    a = toxic / n
    of_clean = F.when(clean > 0, (1 - a) * F.log((1 - a) / F.lit(1 - share))).otherwise(0.0)
    return F.when(a <= share, 1.0).otherwise(F.exp(-n * (a * F.log(a / F.lit(share)) + of_clean)))


def choose_terms(rows: list) -> tuple[list[str], list[str]]:
    """Words and stems. A beginning is a stem where words branch off it; one that only goes on, or that is
    itself the word that makes it count, is not."""
    whole = {r["term"]: r["toxic"] for r in rows if r["whole"]}
    begins = {r["term"]: r["toxic"] for r in rows if not r["whole"]}
    longest: dict[str, int] = {}
    for t, n in begins.items():
        longest[t[:-1]] = max(longest.get(t[:-1], 0), n)
    stems: list[str] = []
    for t in sorted(begins, key=lambda t: (len(t), t)):
        if longest.get(t, 0) >= 0.9 * begins[t] or whole.get(t, 0) >= 0.5 * begins[t] or any(t.startswith(s) for s in stems):
            continue
        stems.append(t)
    words = sorted((t for t in whole if not any(t.startswith(s) for s in stems)), key=lambda t: (-whole[t], t))
    return words, stems


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out fold, ``MOST_LABELLED`` of them at most (chosen by a hash).

    Rows with a null id or a label other than 0 and 1 are left out; of an id's labels the largest counts.
    Without labelled rows, or without a class, every score is 0.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    n = known.count()
    if n > MOST_LABELLED:
        known = known.where(hashed_unit(F.lit("fit"), "doc_id") < F.lit(MOST_LABELLED / n))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(known) if n <= MOST_LABELLED else known, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["text"]))  # else copies make terms of rare words
    counts = sample.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in counts}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model(Lexicon([], []), np.array([-40.0] + [0.0] * len(FEATURES)))
    share = toxic / (toxic + clean)
    ratio = lambda t, c, least: (F.col(t) + 0.1) / (toxic + 1) >= F.lit(least) * (F.col(c) + 0.1) / (clean + 1)
    by_docs = (F.col("toxic") >= LEAST_DOCS) & ratio("toxic", "clean", LEAST_RATIO) & (chance(F.col("toxic"), F.col("clean"), share) <= MOST_CHANCE)
    by_words = ~F.col("whole") & (F.col("toxic") >= FEWER_DOCS) & (F.col("toxic_words") >= WORDS_A_DOC * F.col("toxic")) & ratio("toxic_words", "clean_words", WORDS_RATIO) & (chance(F.col("toxic_words"), F.col("clean_words"), share) <= WORDS_CHANCE)
    # every term that passes is taken; the sample bounds them
    rows = term_counts(sample).where(by_docs | by_words).select("term", "whole", "toxic").collect()
    words, stems = choose_terms(rows)
    lexicon = Lexicon(words, stems)
    x, y, near = sample_features(sample, lexicon)
    # a term whose misspellings are met in clean texts as often as in toxic ones is matched exactly from now on
    kept, kept_stems = keep_fuzzy(words, False, near, y), keep_fuzzy(stems, True, near, y)
    if (kept, kept_stems) != tuple([w for w in t if len(w) >= FUZZY_FROM] for t in (words, stems)):
        lexicon = Lexicon(words, stems, kept, kept_stems)
        x, y, _ = sample_features(sample, lexicon)
    return Model(lexicon, logistic(x, y))


def keep_fuzzy(terms: list[str], stem: bool, near: list[list[str]], y) -> list[str]:
    """The terms (of ``FUZZY_FROM`` letters) whose misspellings are met in more toxic texts than clean ones, or in none."""
    of_word: dict[str, list[int]] = {}
    for i, found in enumerate(near):
        for v in found:
            of_word.setdefault(v, []).append(i)
    kept = []
    for w in terms:
        if len(w) < FUZZY_FROM:
            continue
        alone = Lexicon([], [w]) if stem else Lexicon([w], [])
        of = {i for v, at in of_word.items() if alone.match(v) for i in at}
        if not of or np.mean([y[i] for i in of]) > 0.5:
            kept.append(w)
    return kept


def sample_features(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Features, labels and the words matched with an error of the sample's texts, ``MOST_LABELLED`` of them."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            rows = [features(t, lexicon) for t in texts]
            near = [[w for w, k in lexicon.hits(candidates(WORD.findall((t or "").lower()))).items() if k == "fuzzy"] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.string()))], ["toxic", "x", "near"])

    got = sample.mapInArrow(run, "toxic int, x array<double>, near array<string>").collect()
    return np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float), [r["near"] for r in got]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton's method; all but the intercept shrink to 0."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(a.shape[1]), np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + shrink, a.T @ (y - p) - shrink @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (0 to 1) and predicted (0 or 1) to ``docs`` (text; other columns stay, these two are replaced).

    Each whole text is scored on its own: letters are lower-cased, words looked up in the lexicon with up to
    one error, and hits within quotation marks counted apart. Null and empty texts get the score of a text
    without hits. Repeated rows get equal scores; an empty table gives an empty result.
    """
    from pyspark.sql import types as T

    kept = docs.drop("score", "predicted")
    box = Shipped(docs.sparkSession, model)  # at most a few thousand terms

    def run(batches):
        model = box.get()
        for b in batches:
            s = np.array([model.score(t.as_py()) for t in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])
        pa.default_memory_pool().release_unused()  # texts of the batches; the worker lives on

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
