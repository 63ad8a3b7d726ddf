"""The pipeline against a plain version, and its stages' edge cases."""

import hashlib
import itertools
import math

import numpy as np
import pytest

import corpus_pipeline
from gradeloom.llm import toxicity
from gradeloom.llm.queries import unigram_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=9):
    r = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in r.integers(0, 3000, int(r.integers(5, 80)))]
        if i % 6 == 5:
            words.insert(len(words) // 2, "grunkel")
        if i % 7 == 3:
            words += [passage]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    rows += [(100, rows[4][1], "en", "s0"), (101, rows[8][1] + " tail", "de", "s1"), (102, None, None, None), (103, "", "en", "s1"), (104, rows[10][1].upper(), "en", "s2"), (105, "short ▁ text", "en", "s2")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def words_of(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""}


def near_copies(rows):
    sets, up = [words_of(r[1]) for r in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up = [up[a] if x == up[b] else x for x in up]
    first = {}
    for i, r in enumerate(rows):
        first[up[i]] = min(first.get(up[i], r[0]), r[0])
    return [r for i, r in enumerate(rows) if r[0] == first[up[i]]]


def cut_repeats(rows, least=50):
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1):
            first[b[i : i + least]] = min(d, first.get(b[i : i + least], d))
    out = []
    for d, t, lang, source, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        out.append((d, text, lang, source, len(text)))
    return out


def mixed(rows, seed=17):
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t or "")
    w = {s: math.floor(math.sqrt(n) * 1e6) for s, n in sizes.items()}
    out = []
    for row in rows:
        s = row[3]
        rate = 1.0 if not sizes[s] else w[s] / sum(w.values()) * (sum(sizes.values()) / sizes[s])
        u = (int(hashlib.md5(f"{seed}:{row[0]}:{hashlib.md5((row[1] or '').encode()).hexdigest()}:".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c < u:
            n += 1
            p *= rate / n
            c += p
        out += [row] * n
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int("grunkel" in (t or ""))) for d, t, *_ in rows if d < 60], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_equals_the_plain_version(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model, u = toxicity.fit(docs, labels), unigram_model()
    kept = [r for r in corpus() if model.score(r[1]) < toxicity.THRESHOLD]
    assert not any("grunkel" in (r[1] or "") for r in kept) and len(kept) > 50
    want = []
    for d, t, _, s, _ in mixed(cut_repeats(near_copies(kept))):
        want.append((d, s, u.encode([t])[0].tolist()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert all(r.roundtrip for r in got)
    assert sorted(((r.doc_id, r.source, r.ids) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_and_odd_tables(spark, folder, stage):
    docs = spark.createDataFrame(corpus()[:6] + [(None, None, None, None, None), (7, "x " * 40_000, "en", "s0", 80_000), (7, "x " * 40_000, "en", "s0", 80_000)], SCHEMA)
    out = stage(spark, docs, folder)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), folder).count() == 0
