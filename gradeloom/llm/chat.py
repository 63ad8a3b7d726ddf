"""Transcript parsing: a hidden Markov model over lines recovers who speaks, then turns are rendered canonically."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import cut, partitions

ROLES = ("system", "user", "assistant")
#: A state is a role that begins a turn, or one that goes on with it.
STATES = [(r, begins) for r in range(len(ROLES)) for begins in (True, False)]
# What speakers are called in transcripts.
MARKERS = {
    "user": ("user", "human", "q", "question", "you", "customer", "prompter"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "gpt", "agent"),
    "system": ("system", "instructions", "context"),
}
MARKER = re.compile(r"^\s*(?:[#>*\-]+\s*|<\|?|\[)?\s*({})\s*(?:\|?>|\]|\*\*)?\s*(?::|\|>|\]|>)\s*\**\s*".format("|".join(sorted((w for m in MARKERS.values() for w in m), key=len, reverse=True))), re.I)
ROLE_OF = {w: r for r, role in enumerate(ROLES) for w in MARKERS[role]}
#: Classes of each feature of a line: marker (none or one of the roles), length, ending, after an empty line.
SIZES = (4, 5, 3, 2)
#: Pieces of a transcript that are decoded as one step of a chain, at most; longer transcripts are chains of steps.
CHUNK = 256
#: Conversations that the model is counted on, at most (in expectation, chosen by a hash).
MOST_FITTED = 20_000
TURN_END = "<|end|>"
#: Lines, padding included, that Viterbi runs through together.
TOGETHER = 1 << 16


def line_features(line: str, after_empty: bool) -> tuple[int, int, int, int]:
    m = MARKER.match(line)
    n = len(line.split())
    tail = line.rstrip()[-1:] or " "
    return (1 + ROLE_OF[m[1].lower()] if m else 0, min(4, int(np.log2(n + 1) / 1.5)), 0 if tail == "?" else 1 if tail in ".!" else 2, int(after_empty))


def without_marker(line: str) -> str:
    return MARKER.sub("", line, count=1)


class Hmm:
    """Log probabilities of starts, steps and of each feature's classes, one row a state."""

    def __init__(self, start, step, emit):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def counted(cls, rows: list[tuple[int, int, int, int]]) -> Hmm:
        """From counts (kind, a, b, n): kind 0 start of a, 1 step from a to b, 2 + f feature f of class b in state a."""
        k = len(STATES)
        start, step, emit = np.full(k, 0.5), np.full((k, k), 0.5), [np.full((k, s), 0.5) for s in SIZES]
        for kind, a, b, n in rows:
            if kind == 0:
                start[a] += n
            elif kind == 1:
                step[a, b] += n
            else:
                emit[kind - 2][a, b] += n
        for i, (_, begins) in enumerate(STATES):
            if not begins:
                start[i] = 0  # a transcript begins with a turn
            for j, (r2, b2) in enumerate(STATES):
                if not b2 and STATES[i][0] != r2:
                    step[i, j] = 0  # only its own speaker goes on with a turn
        with np.errstate(divide="ignore"):
            return cls(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])

    def lines(self, f: np.ndarray) -> np.ndarray:
        """(lines, states): log probability of each line's features."""
        return sum(e[:, f[:, i]] for i, e in enumerate(self.emit)).T

    def through(self, e: np.ndarray, first: bool) -> np.ndarray:
        """(from, to): best log probability of these lines given the state before them; with ``first``, of a start."""
        m = np.full((len(STATES),) * 2, -np.inf)
        if first:
            m[:] = self.start + e[0]
        else:
            m = self.step + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + row
        return m

    def paths(self, e: list[np.ndarray], before: list[int], last: list[int]) -> list[np.ndarray]:
        """The best states of each sequence of lines, given the state before it (-1: it starts) and its last one (-1: any).

        Sequences of like length run together, ``TOGETHER`` cells at most unless one alone is longer.
        """
        out: list = [None] * len(e)
        size = np.array([len(x) for x in e])
        order, at = np.argsort(size, kind="stable"), 0
        while at < len(order):
            n = 1
            while at + n < len(order) and size[order[at + n]] * (n + 1) <= TOGETHER:
                n += 1
            ids = order[at : at + n]
            at += n
            for i, states in zip(ids, self._together([e[i] for i in ids], size[ids], np.array(before)[ids], np.array(last)[ids])):
                out[i] = states
        return out

    def _together(self, e, size, before, last):
        n, steps, k = len(e), int(size.max()), len(STATES)
        x, back = np.zeros((steps, n, k)), np.empty((steps, n, k), np.int8)
        for i, rows in enumerate(e):
            x[: size[i], i] = rows
        v = np.where((before < 0)[:, None], self.start, self.step[before]) + x[0]
        for t in range(1, steps):
            cand, live = v[:, :, None] + self.step, (size > t)[:, None]
            back[t] = np.where(live, cand.argmax(axis=1), np.arange(k))  # past its end a sequence stays where it is
            v = np.where(live, cand.max(axis=1) + x[t], v)
        states = np.empty((steps, n), np.int64)
        states[-1] = np.where(last < 0, v.argmax(axis=1), last)
        for t in range(steps - 1, 0, -1):
            states[t - 1] = back[t][np.arange(n), states[t]]
        return [states[: size[i], i] for i in range(n)]


def _plain(ids) -> pd.Series:
    """Ids as Python strings and None, in one piece of memory."""
    return pd.Series([x if isinstance(x, str) else None for x in ids], dtype=object)


def in_chunks(pieces: DataFrame, *order: str) -> DataFrame:
    """Add chunk (long) and place (int, from 0) to ``pieces``: at most ``CHUNK`` neighbours in the order of these columns share a chunk.

    Rows are dealt out by ranges of the whole order, and counted through: partitions count their rows first,
    then number them from their offset on. So pieces of one key, null or not, fall into as many chunks as
    they need; a chunk number is shared by neighbouring keys. Ties are broken by a number of the written rows.
    """
    spark = pieces.sparkSession
    n = max(1, partitions(spark))
    kept = cut(pieces.withColumn("__tie", F.monotonically_increasing_id()))
    dealt = cut(kept.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").withColumn("__at", F.monotonically_increasing_id()))
    part, low = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()}  # one row a partition
    offsets, at = {}, 0
    for p in range(max(sizes, default=-1) + 1):
        offsets[p] = at
        at += sizes.get(p, 0)
    starts = F.array(*[F.lit(offsets[p]).cast("long") for p in sorted(offsets)]) if offsets else F.array(F.lit(0).cast("long"))
    index = F.element_at(starts, (part + 1).cast("int")) + low
    return dealt.withColumns({"chunk": F.floor(index / CHUNK).cast("long"), "place": (index % CHUNK).cast("int")}).drop("__tie", "__at")


def fit(labelled: DataFrame) -> Hmm:
    """Count starts, steps and features on labelled pieces (conv_id, pos, role, text).

    Of more than ``MOST_FITTED`` conversations, those with the smallest hashes are used, as many in
    expectation. Rows of other roles, or with a null role or conv_id, are left out. Steps are counted within
    chunks of neighbouring pieces, so that a long conversation is shared out; a conversation starts with its
    smallest pos.
    """
    known = labelled.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    n = known.select("conv_id").distinct().count()
    if n > MOST_FITTED:
        known = known.where(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < F.lit(1_000_000 * MOST_FITTED / n))
    role = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)])
    pieces = in_chunks(known.select("conv_id", F.coalesce(F.col("pos").cast("long"), F.lit(-(2**62))).alias("pos"), F.coalesce("text", F.lit("")).alias("text"), role.alias("r")), "conv_id", "pos", "text")
    first = pieces.groupBy(F.col("conv_id").alias("__c")).agg(F.min(F.struct("chunk", "place")).alias("__first"))
    pieces = pieces.join(first, F.col("conv_id") == F.col("__c")).withColumn("opens", F.struct("chunk", "place") == F.col("__first"))

    def counted(batches):
        for p in batches:
            rows = []
            for conv, chunk, place, opens, r, text in zip(p["conv_id"], p["chunk"], p["place"], p["opens"], p["r"], p["text"]):
                empty = False
                for k, line in enumerate(text.split("\n")):
                    rows.append((conv, chunk, place, k, bool(opens and not k), r * 2 + (k > 0), *line_features(line, empty)))
                    empty = not line.strip()
            yield pd.DataFrame(rows, columns=["conv_id", "chunk", "place", "k", "opens", "state", "f0", "f1", "f2", "f3"])

    s = pieces.select(F.col("conv_id").cast("string").alias("conv_id"), "chunk", "place", "opens", "r", "text").mapInPandas(counted, "conv_id string, chunk long, place int, k int, opens boolean, state int, f0 int, f1 int, f2 int, f3 int")
    w = Window.partitionBy("conv_id", "chunk").orderBy("place", "k")
    s = s.withColumn("before", F.lag("state").over(w))
    item = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    first = F.when(F.col("opens"), item(0, F.col("state"), F.lit(0))).when(F.col("before").isNotNull(), item(1, F.col("before"), F.col("state")))
    counts = s.select(F.explode(F.array_compact(F.array(first, *[item(2 + i, F.col("state"), F.col(f"f{i}")) for i in range(len(SIZES))]))).alias("c")).groupBy("c.kind", "c.a", "c.b").count()
    return Hmm.counted([tuple(r) for r in counts.collect()])  # at most states x (states + classes) rows


def parse(transcripts: DataFrame, hmm: Hmm) -> DataFrame:
    """(conv_id, turn, role, text, rendered) for each recovered turn of ``transcripts`` (conv_id, pos, text).

    The pieces of a conversation, in order of pos, are its lines; other columns are not used. Viterbi finds
    the best states of all lines. A conversation is cut into chunks of neighbouring pieces, by their number and
    not by pos: each chunk becomes a matrix of best passages between states, the chain of matrices is solved,
    one small row a chunk, and then each chunk is traced back on its own, so one very long conversation, or
    one of many null or equal pos, is shared out over tasks. A conversation of one chunk needs no chain.

    Nulls: a null text is an empty line; a null conv_id is a conversation of its own; a null pos comes first.
    Pieces with equal pos are taken in order of text. Repeated rows are repeated lines. Empty in, empty out.
    """
    kind = "string"  # within pandas, so that ids beside a null stay exact
    t = transcripts.select(F.col("conv_id").cast(kind).alias("conv_id"), F.coalesce(F.col("pos").cast("long"), F.lit(-(2**62))).alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    lines = cut(lines_of_chunks(in_chunks(t, "conv_id", "pos", "text"), kind))
    longer = lines.groupBy(F.col("conv_id").alias("__c")).agg(F.count("*").alias("m")).where("m > 1")
    chained = lines.select("conv_id", "chunk", "f").join(longer, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi")

    def matrices(batches):
        for p in batches:
            for (conv, chunk), g in p.groupby(["conv_id", "chunk"], sort=False, dropna=False):
                e = hmm.lines(np.frombuffer(b"".join(g["f"]), np.int8).reshape(-1, len(SIZES)).astype(int))
                yield pd.DataFrame({"conv_id": _plain([conv]), "chunk": [chunk], "start": [hmm.through(e, True).tobytes()], "inner": [hmm.through(e, False).tobytes()]})

    small = chained.mapInPandas(matrices, f"conv_id {kind}, chunk long, start binary, inner binary")

    def chain(p):
        p = p.sort_values("chunk")
        k, best, back = len(STATES), None, []
        for i, (s, m) in enumerate(zip(p["start"], p["inner"])):
            if i == 0:
                best = np.frombuffer(s).reshape(k, k)[0]
            else:
                cand = best[:, None] + np.frombuffer(m).reshape(k, k)
                back.append(cand.argmax(axis=0))
                best = cand.max(axis=0)
        last = [int(best.argmax())]
        for b in back[::-1]:
            last.append(int(b[last[-1]]))
        last = last[::-1]
        return pd.DataFrame({"conv_id": _plain(p["conv_id"]), "chunk": p["chunk"].tolist(), "before": [-1, *last[:-1]], "last": last})

    ends = small.groupBy("conv_id").applyInPandas(chain, f"conv_id {kind}, chunk long, before int, last int")

    def traced(batches):
        for p in batches:
            rows = []
            before, last = (p[c].fillna(-1).astype(int).tolist() for c in ("before", "last"))
            found = hmm.paths([hmm.lines(np.frombuffer(f, np.int8).reshape(-1, len(SIZES)).astype(int)) for f in p["f"]], before, last)
            for conv, chunk, text, states in zip(p["conv_id"], p["chunk"], p["lines"], found):
                seq = 0
                for k, (s, line) in enumerate(zip(states, text)):
                    role, begins = STATES[s]
                    seq += begins
                    if begins or not k:
                        rows.append([conv, chunk, seq, role, begins, []])
                    rows[-1][5].append(without_marker(line) if begins else line)
            yield pd.DataFrame([(c, h, q, r, b, "\n".join(t)) for (c, h, q, r, b, t), c in zip(rows, _plain([x[0] for x in rows]))], columns=["conv_id", "chunk", "seq", "role", "begins", "text"])

    joined = lines.join(ends.withColumnRenamed("conv_id", "__c").withColumnRenamed("chunk", "__h"), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__h")), "left")
    parts = cut(joined.select("conv_id", "chunk", "f", "lines", "before", "last").mapInPandas(traced, f"conv_id {kind}, chunk long, seq int, role int, begins boolean, text string"))
    # turns are numbered within their chunk, and chunks by what has begun before; a turn may go on over chunks
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.groupBy("conv_id", "chunk").agg(F.max("seq").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    begun = begun.select(F.col("conv_id").alias("__c"), F.col("chunk").alias("__h"), "offset")
    parts = parts.join(begun, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__h"))).withColumn("turn", F.col("offset") + F.col("seq") - 1)
    turns = parts.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("begins"), F.col("role"))).alias("r"), F.array_sort(F.collect_list(F.struct("chunk", "seq", "text"))).alias("p"))
    names = F.array(*[F.lit(r) for r in ROLES])
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return turns.select(F.col("conv_id").cast(transcripts.schema["conv_id"].dataType).alias("conv_id"), F.col("turn").cast("int").alias("turn"), F.element_at(names, F.col("r") + 1).alias("role"), F.trim(text).alias("text")).withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n" + TURN_END + "\n")))


def lines_of_chunks(t: DataFrame, kind: str) -> DataFrame:
    """(conv_id, chunk, lines array, f binary): the lines of each block of pieces and their features."""

    def run(batches):
        for p in batches:
            all_lines, all_f = [], []
            for pieces in p["pieces"]:
                lines, f = [], []
                for piece in pieces:
                    empty = False
                    for line in piece["text"].split("\n"):
                        lines.append(line)
                        f.append(line_features(line, empty))
                        empty = not line.strip()
                all_lines.append(lines)
                all_f.append(np.array(f, np.int8).tobytes())
            yield pd.DataFrame({"conv_id": _plain(p["conv_id"]), "chunk": p["chunk"].tolist(), "lines": pd.Series(all_lines, dtype=object), "f": all_f})

    chunks = t.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("pieces"))
    return chunks.mapInPandas(run, f"conv_id {kind}, chunk long, lines array<string>, f binary")


def held_out(conv_id):
    """Conversations, one in four by a hash, whose roles the model is not fitted on."""
    return F.coalesce(F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: (conv_id, pos, text, role); role is for fitting and tests only.

    Speakers are marked in one of five ways, chosen by conv_id; one turn in five has no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    role = F.col("role")
    mark = (
        F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
        .when(style == 1, F.when(role == "user", F.lit("Q: ")).when(role == "assistant", F.lit("A: ")).otherwise(F.lit("Context: ")))
        .when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>")))
        .when(style == 3, F.concat(F.lit("### "), F.when(role == "user", F.lit("Human")).when(role == "assistant", F.lit("Assistant")).otherwise(F.lit("System")), F.lit(": ")))
        .otherwise(F.concat(F.lit("["), F.upper(role), F.lit("]: ")))
    )
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)).isin(0, 1) | role.isNull()
    return conversations.select("conv_id", F.col("turn").alias("pos"), F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"), "role")
