"""Phrase collocations: depth-limited count tries per shard, merged by ranges of prefixes.

A shard is a run of whole texts of a task. Its trie holds every phrase of up to ``DEPTH`` words as a sorted
array of (parent, word, count) a level. The tries are grown in two goes, which loses nothing: first pairs
only, whose counts (by 64-bit hash) are added up over all shards; then all levels, below pairs that reach
``LEAST`` (a set of bits sized to their number; a false hit only costs work). A trie is written out in
sorted order and dealt by ranges of phrases; a shard sends the counts along the path to a range's first
phrase to that range too, so every range has its ancestors. Spark sorts a range's rows, a task merges them
as they stream by, and a walk down the merged trie gives a phrase's left parts. Its right parts come by
suffix links, a phrase without its first word, as a join level by level.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Shipped, cut, partitions
from gradeloom.llm.ranking import best_rows

DEPTH = 4
LEAST, INSIDE, MOST_A_LANG = 30, 80, 2000
#: A shard ends at so many words, a piece of text that is read at once at so many bytes (at the end of a piece).
SHARD_WORDS, READ_BYTES = 1 << 20, 1 << 24
#: Bits a frequent pair, and most bits of the set that tasks read (128 MB; beyond it the set rules out less, the result is the same).
PAIR_BITS, MOST_BITS = 16, 1 << 30
#: Text bytes a range, and most ranges.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
#: Documents, in expectation, whose phrases tell how to lay ranges.
RANGE_DOCS = 2000

BREAK = b"."
# Fixed values of the rule: signs that end a piece, and the signs between words.
TO_TOKENS = bytes(c + 32 if 65 <= c <= 90 else BREAK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text with a ``BREAK`` after each piece."""
    return text.translate(TO_TOKENS).replace(BREAK, b" . ").split() + [BREAK]


def parts(text: bytes):
    """The text in parts of about ``READ_BYTES``, each ending at the end of a piece."""
    at = 0
    while len(text) - at > READ_BYTES:
        ends = [p for s in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r") if (p := text.find(s, at + READ_BYTES)) >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:] if at else text


def key_of(words: list[bytes]) -> bytes:
    """Bytes that sort as the list of words does: a word's \\x00 and \\x01 are escaped, and \\x00 stands between words."""
    return b"\0".join(w.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in w or b"\1" in w else w for w in words)


def words_of(key: bytes) -> list[bytes]:
    return [w.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in w else w for w in key.split(b"\0")] if key else []


class Texts:
    """A shard's texts, by language: word numbers one after the other, -1 at the end of a piece."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.n, self.langs = 0, {}

    def add(self, lang: str, text: bytes):
        if lang not in self.langs:
            seen: dict = defaultdict()
            seen.default_factory = seen.__len__
            seen[BREAK] = 0
            self.langs[lang] = (seen, [])
        seen, arrays = self.langs[lang]
        for part in parts(text):
            found = tokens(part)
            arrays.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
            self.n += len(found)

    def numbered(self):
        """(lang, words in order, word numbers by that order) of each language."""
        for lang, (seen, arrays) in sorted(self.langs.items()):
            words = sorted(w for w in seen if w != BREAK)  # as their keys
            order = np.empty(len(seen), np.int64)
            order[0] = -1
            order[[seen[w] for w in words]] = np.arange(len(words))
            yield lang, words, order[np.concatenate(arrays)]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in that order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor(b, b >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def pair_hashes(lang: str, words: list[bytes], pairs: np.ndarray) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return mixed(h[pairs // len(words)], h[pairs % len(words)])


def shards(batches, make, most_words: int = SHARD_WORDS):
    """``make(texts)`` of each shard of a task's batches (lang, text as bytes)."""
    texts = Texts()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            texts.add(lang, text.as_py())
            if texts.n >= most_words:
                yield from make(texts)
                texts.clear()
    if texts.n:
        yield from make(texts)


def pairs_of(x: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that start a pair within a piece, and the pairs' codes."""
    at = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
    return at, x[at] * n_words + x[at + 1]


def pair_counts(texts: DataFrame, shard_words: int) -> DataFrame:
    """(pair long, c long): how often each pair of words (by hash) stands in a piece, over all shards."""

    def make(shard):
        for lang, words, x in shard.numbered():
            codes, counts = np.unique(pairs_of(x, len(words))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(lang, words, codes).view(np.int64)), pa.array(counts.astype(np.int64))], ["pair", "c"])

    return texts.mapInArrow(lambda batches: shards(batches, make, shard_words), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


class Bits:
    """A set of hashes as bits: never denies a member."""

    def __init__(self, bits: int, rows: list):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(max(bits // 8, 4096), np.uint8)
        for r in rows:
            self.bytes[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_pairs(texts: DataFrame, least: int, shard_words: int = SHARD_WORDS) -> Bits:
    """The pairs that reach ``least`` over all shards, put together as bits by Spark."""
    pairs = cut(pair_counts(texts, shard_words).where(F.col("c") >= least).select("pair"))
    bits = 1 << 20
    while bits < min(PAIR_BITS * pairs.count(), MOST_BITS):
        bits *= 2
    at = F.col("pair").bitwiseAND(F.lit(bits - 1))
    rows = pairs.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return Bits(bits, rows.collect())


class Trie:
    """The levels of one shard and language: sorted codes (parent's place times the number of words, plus the word), and counts."""

    def __init__(self, words: list[bytes], x: np.ndarray, kept=None, depth: int = DEPTH):
        self.words, self.size = words, max(1, len(words))
        self.codes = [np.arange(len(words))]
        self.counts = [np.bincount(x[x >= 0], minlength=len(words))]
        here = x  # the node of the phrase that starts at each position, of the level before
        for level in range(2, depth + 1):
            n = len(x) - level + 1
            at = np.flatnonzero((here[:n] >= 0) & (here[1 : n + 1] >= 0) & (x[level - 1 :][:n] >= 0)) if n > 0 else np.zeros(0, np.int64)
            codes, place, counts = np.unique(here[at] * self.size + x[at + level - 1], return_inverse=True, return_counts=True)
            if level == 2 and kept is not None:
                stays = kept(codes)
                renumbered = np.where(stays, np.cumsum(stays) - 1, -1)
                codes, counts, place = codes[stays], counts[stays], renumbered[place]
            self.codes.append(codes)
            self.counts.append(counts)
            here = np.full(len(x), -1, np.int64)
            here[at] = place

    def path(self, level: int, i: int) -> list[bytes]:
        """The words of node ``i`` of a level (from 1)."""
        out = []
        while level > 1:
            i, w = divmod(int(self.codes[level - 1][i]), self.size)
            out.append(self.words[w])
            level -= 1
        return [self.words[i], *reversed(out)] if level == 1 else []

    def count(self, phrase: list[bytes], numbers: dict[bytes, int]) -> int:
        i = numbers.get(phrase[0], -1)
        for level, w in enumerate(phrase[1:], 1):
            if i < 0 or w not in numbers:
                return 0
            code = i * self.size + numbers[w]
            j = int(np.searchsorted(self.codes[level], code))
            i = j if j < len(self.codes[level]) and self.codes[level][j] == code else -1
        return int(self.counts[len(phrase) - 1][i]) if i >= 0 else 0

    def keys(self, escaped: pa.Array):
        """Of each level the phrases' keys."""
        above = escaped
        yield above
        for codes in self.codes[1:]:
            above = pc.binary_join_element_wise(above.take(pa.array(codes // self.size)), escaped.take(pa.array(codes % self.size)), b"\0")
            yield above

    def ranges(self, level: int, bounds: list[bytes]) -> np.ndarray:
        """The range that each node of a level falls into: how many bounds are not above it."""
        n = len(self.codes[level - 1])
        places = [_first(n, lambda i, b=b: key_of(self.path(level, i)) >= b) for b in bounds]
        return np.repeat(np.arange(len(bounds) + 1), np.diff([0, *places, n]))


def _first(n: int, holds) -> int:
    """The first of 0..n-1 that holds (from there on all do), or n."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        if holds(mid):
            high = mid
        else:
            low = mid + 1
    return low


def ordered(where: int, lang: str) -> bytes:
    """What a range's phrases of a language begin with in the order of the merge; a key follows."""
    return where.to_bytes(4, "big") + key_of([lang.encode("utf-8", "surrogatepass")]) + b"\0"


def node_rows(texts: DataFrame, pairs: Shipped, bounds: Shipped, depth: int, shard_words: int) -> DataFrame:
    """(node binary, c long): the shards' tries, written out in order, with the paths to the ranges' first phrases.

    A node is its range, language and key in one; the empty key counts all words.
    """

    def batch(nodes, counts):
        return pa.RecordBatch.from_arrays([nodes, pa.array(counts, pa.int64())], ["node", "c"])

    def run(batches):
        kept, limits = pairs.get(), bounds.get()
        langs = [b[0] for b in limits]

        def make(shard):
            for lang, words, x in shard.numbered():
                trie = Trie(words, x, lambda codes, words=words, lang=lang: kept.has(pair_hashes(lang, words, codes)), depth)
                first, last = _first(len(langs), lambda i: langs[i] >= lang), _first(len(langs), lambda i: langs[i] > lang)
                own = [b[1] for b in limits[first:last]]
                begins = [ordered(first + i, lang) for i in range(len(own) + 1)]
                numbers = {w: i for i, w in enumerate(words)}
                paths = [(begins[0], int((x >= 0).sum()))]
                for i, b in enumerate(own, 1):
                    path = words_of(b)
                    paths += [(begins[i] + key_of(path[:k]), c) for k in range(1, len(path)) if (c := trie.count(path[:k], numbers))]
                yield batch(pa.array([p[0] for p in paths], pa.binary()), [p[1] for p in paths])
                begins = pa.array(begins, pa.binary())
                for level, keys in enumerate(trie.keys(pa.array([key_of([w]) for w in words], pa.binary())), 1):
                    ranges = trie.ranges(level, own)
                    for at in range(0, len(keys), 100_000):
                        nodes = pc.binary_join_element_wise(begins.take(pa.array(ranges[at : at + 100_000])), keys.slice(at, 100_000), b"")
                        yield batch(nodes, trie.counts[level - 1][at : at + 100_000])

        yield from shards(batches, make, shard_words)
        pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "node binary, c long")


def merged(batches, least: int, bounds: list):
    """The merged tries of a task's ranges, from rows sorted by node: those that reach ``least``.

    Yields (lang, key, phrase, depth, f, lefts, link, inside): counts of the left parts, the phrase without its
    first word, and the shorter phrases inside. The path to a range's first phrase only serves its descendants.
    """
    path: list[tuple[bytes, int]] = []
    here = held = None
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if t is None:
            return
        t = t.combine_chunks()
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            node = t["node"].chunk(0)
            new[1:] = np.asarray(pc.not_equal(node[1:], node[:-1]))
        starts = np.flatnonzero(new)
        if b is not None:  # the last group may go on
            held, t, starts = t.slice(starts[-1]), t.slice(0, starts[-1]), starts[:-1]
        if not len(starts):
            continue
        sums = np.add.reduceat(t["c"].to_numpy(), starts)
        nodes = t["node"].take(pa.array(starts))
        wanted = np.flatnonzero((sums >= least) | np.asarray(pc.ends_with(nodes, b"\0")))  # no key ends so: all words
        out = []
        for node, f in zip(nodes.take(pa.array(wanted)).to_pylist(), sums[wanted].tolist()):
            lang, _, key = node[4:].partition(b"\0")
            if (node[:4], lang) != here:
                here, path = (node[:4], lang), []
                where, lang_name = int.from_bytes(node[:4], "big"), words_of(lang)[0].decode("utf-8", "surrogatepass") if lang else ""
            if not key:
                out.append((lang_name, key, b"", 0, f, [], None, []))
                continue
            while path and not key.startswith(path[-1][0] + b"\0"):
                path.pop()
            lefts = [n for _, n in path]
            path.append((key, f))
            if where > 0 and bounds[where - 1][0] == lang_name and key < bounds[where - 1][1]:
                continue
            w = key.split(b"\0")
            inside = [b"\0".join(w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)]
            out.append((lang_name, key, b" ".join(words_of(key)), len(w), f, lefts, b"\0".join(w[1:]) if len(w) > 1 else None, inside))
        if out:
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["lang", "key", "phrase", "depth", "f", "lefts", "link", "inside"])


MERGED = "lang string, key binary, phrase binary, depth int, f long, lefts array<long>, link binary, inside array<binary>"


def range_bounds(texts: DataFrame, depth: int, range_bytes: int = RANGE_BYTES) -> list[tuple[str, bytes]]:
    """First phrases (lang, key) of all ranges but the first, from phrases of about ``RANGE_DOCS`` documents.

    They only say how work is dealt out.
    """
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size["n"]:
        return []
    wanted = int(min(MOST_RANGES, max(partitions(texts.sparkSession), (size["bytes"] or 0) // range_bytes)))

    def run(batches):
        for b in batches:
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                w = tokens(text[:READ_BYTES])
                for i in range(hash_of(lang, w) % 20, len(w), 20):
                    piece = w[i : i + depth]
                    piece = piece[: piece.index(BREAK)] if BREAK in piece else piece
                    rows += [(lang, key_of(piece))] if piece else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "key"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, size["n"] // RANGE_DOCS))) == 0)
    rows = some.mapInArrow(run, "lang string, key binary").withColumn("o", F.xxhash64("lang", "key", F.monotonically_increasing_id())).orderBy("o").limit(100_000).collect()
    keys = sorted((r["lang"], bytes(r["key"])) for r in rows)
    return sorted({keys[i * len(keys) // wanted] for i in range(1, wanted)}) if keys else []


def hash_of(lang: str, words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(words[0] if words else b"", len(words))


def phrase_counts(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, shard_words: int = SHARD_WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every phrase of up to ``depth`` words that stands ``least`` times in its language, and a row of depth 0 for all words.

    Columns lang, key, phrase, depth, f, lefts, link, inside as ``merged`` gives them. Null texts are empty; a null lang is 'und'.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    limits = range_bounds(texts, depth, range_bytes)
    bounds, pairs = Shipped(spark, limits), Shipped(spark, frequent_pairs(texts, least, shard_words))
    rows = node_rows(texts, pairs, bounds, depth, shard_words).repartition(max(partitions(spark), len(limits) + 1), F.substring("node", 1, 4)).sortWithinPartitions("node")
    return cut(rows.mapInArrow(lambda batches: merged(batches, least, bounds.get()), MERGED))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, most: int = MOST_A_LANG, depth: int = DEPTH, shard_words: int = SHARD_WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each lang's ``most`` best phrases of 2 to ``depth`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its worst cut: floor(2000000 * a / (l + r)), the smallest k of equals. Phrases
    whose words stand inside a longer one that has ``inside`` percent of their count or more are left out.
    Equal scores go by a, then by the phrase's bytes. Null texts and empty ones have no words, a null lang is
    the language 'und' (as a lang of that name), repeated rows count again, other columns are not looked at; an
    empty table, or one without frequent phrases, gives an empty result. ``shard_words`` and ``range_bytes`` only deal out the work.
    """
    nodes = phrase_counts(docs, least, depth, shard_words, range_bytes)
    total = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    level = nodes.where("depth = 1").select("lang", "key", F.expr("array(f)").alias("rights"))
    linked = None
    for d in range(2, depth + 1):
        below = level.select("lang", F.col("key").alias("link"), "rights")
        here = nodes.where(F.col("depth") == d).join(below, ["lang", "link"])
        level = here.select("lang", "key", F.concat(F.array("f"), "rights").alias("rights"))
        rows = here.select("lang", "key", "phrase", "f", "lefts", "rights")
        linked = rows if linked is None else linked.union(rows)
    longer = nodes.where("depth > 2").select("lang", "f", F.explode("inside").alias("key")).groupBy("lang", "key").agg(F.max("f").alias("longer"))
    exact = "cast({} AS decimal(19, 0))".format  # products may pass 64 bits
    cuts = f"transform(lefts, (l, i) -> struct(2000000BD * {exact('f')} div ({exact('l')} + {exact('rights[i]')}) AS score, i + 1 AS k, l, rights[i] AS r))"
    found = linked.join(longer, ["lang", "key"], "left").where(f"longer IS NULL OR 100BD * {exact('longer')} < {int(inside)}BD * {exact('f')}")
    worst = found.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), F.array_min(F.expr(cuts)).alias("cut"))
    best = best_rows(worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _levels(depth: int) -> str:
    """DuckDB's phrases of 1 to ``depth`` words from the words of pieces (d, list)."""
    return " UNION ALL ".join(f"SELECT lang, {k} AS depth, list[i : i + {k - 1}] AS w FROM (SELECT lang, list, unnest(range(1, len(list) - {k - 2})) AS i FROM pieces)" for k in range(1, depth + 1))


#: DuckDB's twin of ``op12``.
COLLOCATION_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS list
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(list)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, w, any_value(depth) AS depth, count(*) AS f FROM ({_levels(DEPTH)}) GROUP BY lang, w HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, w, depth, f AS a, unnest(range(1, depth)) AS k FROM f WHERE depth > 1),
scored AS (
  SELECT c.lang, c.w, c.a, c.k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.w = c.w[1 : c.k] JOIN f r ON r.lang = c.lang AND r.w = c.w[c.k + 1 : c.depth]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
spans AS (SELECT lang, w, f, depth, unnest(range(1, depth)) AS i FROM f WHERE depth > 2),
insides AS (SELECT lang, w[i : j] AS w, max(f) AS longer FROM (SELECT lang, w, f, depth, i, unnest(range(i + 1, depth + 1)) AS j FROM spans) WHERE j - i + 1 < depth GROUP BY 1, 2),
left_over AS (
  SELECT worst.lang, array_to_string(worst.w, ' ') AS phrase, a, l, r, score
  FROM worst LEFT JOIN insides ON insides.lang = worst.lang AND insides.w = worst.w WHERE longer IS NULL OR 100::HUGEINT * longer < {INSIDE}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {MOST_A_LANG}
"""
