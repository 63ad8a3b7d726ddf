"""Suffix-array deduplication: repeats that also stand in an earlier document are cut out of the later ones.

How the suffix array is shared out: windows of ``LEAST`` bytes that are equal hold an equal gram of ``GRAM``
bytes at the same place, their smallest by a hash, so only documents' smallest grams ("anchors", one byte in
fourteen) are looked up, and only anchors that two documents have are gone into. Each of these carries its
surroundings, all bytes of the windows that hold it. Surroundings of an anchor meet in one bucket, where
their suffixes are sorted; buckets are the subtrees of one large suffix array that begin with the anchor.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import cut as written, partitions

LEAST, GRAM = 50, 24
SPAN = LEAST - GRAM + 1  # grams of a window
SIDE = SPAN - 1  # bytes of surroundings on the left
WIDE = SIDE + LEAST  # bytes of surroundings
#: Bytes of text in a batch and in a bucket, about. An anchor has at most one entry a batch.
BATCH, BUCKET = 1 << 20, 8 << 20
#: Anchors of more documents than this are looked up window by window, which batches can reduce before.
HOT = 2000
#: Suffixes that are sorted at once, and entries of a bucket that are compared at once; an anchor's stay together.
AT_ONCE, ENTRIES_AT_ONCE = 50_000, 20_000
LAST = 2**63 - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[3]
    return x ^ (x >> np.uint64(32))


def _runs(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Batch:
    """The texts of a batch, one after the other, and their anchors. Texts shorter than a window have none."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(texts) + bytes(WIDE + 64), np.uint8)
        self.n = int(self.size.sum())
        self.at, self.key = self.anchors()
        self.row = np.searchsorted(self.start, self.at, side="right") - 1
        # empty texts share a start with the next one; the last of these is the one that has the bytes

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        n, ends = self.n, (self.start + self.size)[self.size > 0]
        if n < LEAST:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = np.ndarray((n + 32,), "<u8", self.data.tobytes() if not self.data.flags.c_contiguous else self.data, 0, (1,)).astype(np.uint64)
        h = _mixed(words[:n] * _MIX[0] + words[8 : n + 8] * _MIX[1] + words[16 : n + 16] * _MIX[2])
        for back in range(GRAM - 1):
            h[np.maximum(ends - 1 - back, 0)] = np.uint64(LAST * 2 + 1)
        least = _runs(h, SPAN, np.minimum)
        # windows that leave their text hold nothing; padded so that each gram has the windows it is part of
        whole = np.zeros(n + SIDE, np.uint64)
        inside = np.ones(len(least), bool)
        for back in range(LEAST - 1):
            p = ends - 1 - back
            p = p[(p >= 0) & (p < len(inside))]
            inside[p] = False
        whole[SIDE : SIDE + len(least)] = np.where(inside, least, 0)
        at = np.flatnonzero(_runs(whole, SPAN, np.maximum) == h)
        return at, h[at]

    def surroundings(self, at: np.ndarray, row: np.ndarray, left: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, rows of ``width`` bytes and their length): what stands around each place, within its text."""
        lo = np.maximum(at - left, self.start[row])
        hi = np.minimum(at - left + width, self.start[row] + self.size[row])
        cols = np.arange(width)
        out = np.zeros((len(at), width + 1), np.uint8)
        out[:, :width] = np.where(cols < (hi - lo)[:, None], self.data[np.minimum(lo[:, None] + cols, len(self.data) - 1)], 0)
        out[:, width] = hi - lo
        return lo, out


def _texts(p: pd.DataFrame, copies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, text hashes and bytes of a batch's documents, in order of id, without copies of earlier documents."""
    doc, tid = p["doc"].to_numpy(np.int64), p["tid"].to_numpy(np.int64)
    known = set(zip(copies["doc"].tolist(), copies["tid"].tolist()))
    data = p["data"].tolist()
    order = [i for i in np.lexsort((tid, doc)).tolist() if (doc[i], tid[i]) not in known]
    return doc[order], tid[order], [data[i] for i in order]


def _unique_keys(b: Batch, buckets: int):
    """The batch's anchor hashes, once each, by bucket: (bucket, hash, documents that have it)."""
    order = np.argsort(b.key, kind="stable")
    key, row = b.key[order], b.row[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    new_doc = new_key | np.concatenate(([True], row[1:] != row[:-1])) if len(key) else new_key
    first = np.flatnonzero(new_key)
    docs = np.add.reduceat(new_doc, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    key = key[first]
    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    return bucket[order], key[order], docs[order]


KEYS = "bucket int, batch int, keys binary, docs binary"
FLAGS = "batch int, bucket int, flags binary"
ENTRIES = "bucket int, batch int, keys binary, around binary, width int, doc binary, owner binary, tid binary, pos binary, done binary"
PIECES = "batch int, pieces binary"


def _cuts(bucket: np.ndarray):
    """(bucket, from, to) of each run."""
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[edges].tolist(), edges.tolist(), np.append(edges[1:], len(bucket)).tolist())


def _keys(buckets: int):
    def run(p, copies):
        if not len(p):
            return pd.DataFrame([], columns=["bucket", "batch", "keys", "docs"])
        bucket, key, docs = _unique_keys(Batch(_texts(p, copies)[2]), buckets)
        batch = int(p["batch"].iat[0])
        return pd.DataFrame([(k, batch, key[a:z].astype(np.uint32).tobytes(), np.minimum(docs[a:z], 255).astype(np.uint8).tobytes()) for k, a, z in _cuts(bucket)], columns=["bucket", "batch", "keys", "docs"])

    return run


def _flags(hot: int):
    """For each batch which of its keys of this bucket more than one document has (1), or very many (2)."""

    def run(p):
        keys = [np.frombuffer(x, np.uint32) for x in p["keys"]]
        key, docs = np.concatenate(keys), np.concatenate([np.frombuffer(x, np.uint8) for x in p["docs"]]).astype(np.int64)
        _, of, = np.unique(key, return_inverse=True)
        total = np.bincount(of, weights=docs)[of]
        flag = ((total >= 2).astype(np.uint8) + (total > hot)).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        bucket = int(p["bucket"].iat[0])
        return pd.DataFrame([(b, bucket, flag[e - len(k) : e].tobytes()) for b, k, e in zip(p["batch"].tolist(), keys, ends.tolist())], columns=["batch", "bucket", "flags"])

    return run


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    h = np.full(n, _MIX[1])
    for column in wide.view("<u8").T:
        h = _mixed((h ^ column) * _MIX[0])
    return h


def _pack(doc, tid, start, end) -> bytes:
    return np.array([doc, tid, start, end], np.int64).tobytes()


def _entries(buckets: int):
    """The surroundings of a batch's candidate anchors, equal ones once, by bucket.

    Of documents with equal surroundings all but the first are done with: these bytes stand in an earlier
    document. The first one's go on, to be compared with those of other batches.
    """

    def run(p, flags):
        cols = ["bucket", "batch", "keys", "around", "width", "doc", "owner", "tid", "pos", "done"]
        if not len(p) or not len(flags):
            return pd.DataFrame([], columns=cols)
        copies = pd.DataFrame({"doc": flags.loc[flags["bucket"] < 0, "doc"], "tid": flags.loc[flags["bucket"] < 0, "tid"]})
        doc, tid, texts = _texts(p, copies)
        b, batch = Batch(texts), int(p["batch"].iat[0])
        bucket, key, _ = _unique_keys(b, buckets)
        flag = np.zeros(len(key), np.uint8)
        got = {int(k): f for k, f in zip(flags["bucket"], flags["flags"]) if k >= 0}
        for k, lo, hi in _cuts(bucket):
            if k in got:
                flag[lo:hi] = np.frombuffer(got[k], np.uint8)
        order = np.argsort(key)
        of = flag[order][np.searchsorted(key[order], b.key)] if len(key) else flag
        out, done = [], []
        usual, hot = np.flatnonzero(of == 1), np.flatnonzero(of == 2)
        kinds = []
        if len(usual):
            lo, rows = b.surroundings(b.at[usual], b.row[usual], SIDE, WIDE)
            kinds.append((b.key[usual], b.row[usual], lo, rows, WIDE))
        if len(hot):
            places = np.unique((b.at[hot][:, None] - np.arange(SPAN)).ravel())  # windows that hold a hot anchor
            row = np.searchsorted(b.start, places, side="right") - 1
            ok = (places >= 0) & (places + LEAST <= b.start[row] + b.size[row])
            places, row = places[ok], row[ok]
            lo, rows = b.surroundings(places, row, 0, LEAST)
            kinds.append((_hash_rows(rows[:, :LEAST]), row, lo, rows, LEAST))
        for keys, row, lo, rows, width in kinds:
            view = np.ascontiguousarray(rows).view(f"S{width + 1}").ravel()
            order = np.argsort(view, kind="stable")  # rows are in order of doc, so the first of equal ones is the earliest
            v, r = view[order], row[order]
            new = np.concatenate(([True], v[1:] != v[:-1]))
            owner = np.cumsum(new) - 1
            first = order[new]
            later = doc[r] > doc[row[first]][owner]
            size = rows[order, width].astype(np.int64)
            at = lo[order] - b.start[r]
            fits = later & (size >= LEAST)
            done.append((doc[r][fits], tid[r][fits], at[fits], (at + size)[fits]))
            keep = ~later & (size >= LEAST)
            k_bucket = ((keys[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            rank = np.argsort(k_bucket, kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            o, t, a = place[owner[keep]], tid[r][keep], at[keep]
            by = np.argsort(o, kind="stable")
            o, t, a = o[by], t[by], a[by]
            for k, x, y in _cuts(k_bucket[rank]):
                i, (u, w) = first[rank[x:y]], np.searchsorted(o, (x, y))
                out.append((k, batch, keys[i].tobytes(), rows[i].tobytes(), width, doc[row[i]].tobytes(), (o[u:w] - x).astype(np.int32).tobytes(), t[u:w].tobytes(), a[u:w].tobytes(), b""))
        if any(len(d[0]) for d in done):
            out.append((batch % buckets, batch, b"", b"", 0, b"", b"", b"", b"", _pack(*merged(*(np.concatenate(x) for x in zip(*done))))))
        return pd.DataFrame(out, columns=cols)

    return run


def merged(doc, tid, start, end):
    """Overlapping and touching pieces of a document joined."""
    if not len(doc):
        return doc, tid, start, end
    o = np.lexsort((start, tid, doc))
    doc, tid, start, end = doc[o], tid[o], start[o], end[o]
    group = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]))))
    reach = np.maximum.accumulate(end + group * (1 << 40))  # of all pieces so far; a new document starts anew
    new = np.concatenate(([True], start[1:] + group[1:] * (1 << 40) > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tid[first], start[first], reach[last] - group[last] * (1 << 40)


def lcp_intervals(lcp: np.ndarray, least: int, rank: np.ndarray):
    """Scan a suffix array's common prefixes with a stack: (from, to, length, smallest rank) of each interval.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. Intervals of prefixes shorter than ``least`` are
    left out. The result is the interval tree in post-order: inner intervals before those around them.
    """
    out = []
    # only stretches of long prefixes are walked
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([0], long.astype(np.int8), [0]))))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        lengths, ranks = lcp[lo:hi].tolist(), rank[lo - 1 : hi].tolist()
        stack: list[list[int]] = []  # [length, from, smallest]
        for i, length in enumerate(lengths):
            start, small = lo - 1 + i, ranks[i]
            while stack and stack[-1][0] > length:
                n, start, s = stack.pop()
                small = min(small, s)
                out.append((start, lo + i, n, small))
                if stack:
                    stack[-1][2] = min(stack[-1][2], small)
            if not stack or stack[-1][0] < length:
                stack.append([length, start, small])
            else:
                stack[-1][2] = min(stack[-1][2], small)
        small = ranks[-1]
        while stack:
            n, start, s = stack.pop()
            small = min(small, s)
            out.append((start, hi, n, small))
    return out


def maximal_repeats_of(around: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int):
    """Maximal repeats of at least ``LEAST`` bytes among some surroundings.

    Returns (order, intervals): suffixes in order as (row, offset), and (from, to, length, smallest doc) of
    the intervals of the enhanced suffix array whose suffixes differ in what stands before them. A suffix at
    the edge of its surroundings counts as different, for what stands before it isn't seen here.
    """
    each = np.maximum(size - LEAST + 1, 0)
    row = np.repeat(np.arange(len(size)), each)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    wide = np.zeros((len(size), 2 * width), np.uint8)
    wide[:, :width] = around
    suffix = np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)[row, offset]  # no places for each of their bytes
    order = np.argsort(suffix.view(f"S{width}").ravel(), kind="stable")
    row, offset, suffix = row[order], offset[order], suffix[order]
    left = np.where(offset > 0, around[row, np.maximum(offset - 1, 0)].astype(np.int64), -1)
    same = suffix[1:] == suffix[:-1]
    lcp = np.zeros(len(row), np.int64)
    if len(row) > 1:
        length = (size[row] - offset)
        lcp[1:] = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), np.minimum(length[1:], length[:-1]))
    changes = np.cumsum(np.concatenate(([0], ((left[1:] != left[:-1]) | (left[1:] < 0)).astype(np.int64)))) if len(row) else np.zeros(0, np.int64)
    kept = [(a, z, n, s) for a, z, n, s in lcp_intervals(lcp, LEAST, doc[row]) if changes[z - 1] > changes[a] or left[a] < 0]
    return row, offset, np.array(kept, np.int64).reshape(-1, 4)


def covered(around: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to): the bytes of each surroundings that a repeat with an earlier document covers."""
    row, offset, kept = maximal_repeats_of(around, size, doc, width)
    n = kept[:, 1] - kept[:, 0]
    member = np.repeat(kept[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length, small = np.repeat(kept[:, 2], n), np.repeat(kept[:, 3], n)
    late = doc[row[member]] > small
    r, s, length = row[member][late], offset[member][late], length[late]
    paint = np.zeros((len(size), width + 2), np.int32)
    np.add.at(paint, (r, s + 1), 1)
    np.add.at(paint, (r, s + length + 1), -1)
    on = (np.cumsum(paint, axis=1) > 0).astype(np.int8)
    step = np.diff(on, axis=1)
    r, a = np.nonzero(step == 1)
    _, z = np.nonzero(step == -1)
    return r, a, z


def _pieces():
    def run(p):
        out = []
        for batch, done in zip(p["batch"].tolist(), p["done"]):
            if done:
                out.append((batch, done))
        for width in sorted({int(w) for w in p["width"] if w}):
            q = p[p["width"] == width]
            key = np.concatenate([np.frombuffer(x, np.uint64) for x in q["keys"]])
            rows = np.frombuffer(b"".join(q["around"]), np.uint8).reshape(-1, width + 1)
            doc = np.concatenate([np.frombuffer(x, np.int64) for x in q["doc"]])
            counts = np.array([len(x) // 8 for x in q["keys"]])
            base = np.cumsum(counts) - counts
            owner = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + b for x, b in zip(q["owner"], base.tolist())])
            o_batch = np.repeat(q["batch"].to_numpy(np.int64), [len(x) // 4 for x in q["owner"]])
            o_tid = np.concatenate([np.frombuffer(x, np.int64) for x in q["tid"]])
            o_pos = np.concatenate([np.frombuffer(x, np.int64) for x in q["pos"]])
            found = _by_keys(key, rows, doc, width)
            # what was found for surroundings goes to each place that has them
            by = np.argsort(owner, kind="stable")
            o_sorted = owner[by]
            e, a, z = found
            lo, hi = np.searchsorted(o_sorted, e), np.searchsorted(o_sorted, e, side="right")
            n = hi - lo
            place = by[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            start, end, d = o_pos[place] + np.repeat(a, n), o_pos[place] + np.repeat(z, n), doc[np.repeat(e, n)]
            batch, tid = o_batch[place], o_tid[place]
            order = np.argsort(batch, kind="stable")
            for k, x, y in _cuts(batch[order]):
                i = order[x:y]
                out.append((k, _pack(*merged(d[i], tid[i], start[i], end[i]))))
        pa.default_memory_pool().release_unused()  # of the groups before; the worker lives on
        return pd.DataFrame(out, columns=["batch", "pieces"])

    return run


def _by_keys(key, rows, doc, width, most=None):
    """What ``_of_bucket`` gives, found for about ``most`` entries at once: only equal keys are compared, and they stay together."""
    most = most or ENTRIES_AT_ONCE
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    edges = np.searchsorted(sorted_key, sorted_key[most - 1 :: most], side="right").tolist()  # each behind the last of its key
    edges = sorted({0, *edges, len(key)})
    found = []
    for x, y in zip(edges[:-1], edges[1:]):
        i = order[x:y]
        e, a, z = _of_bucket(key[i], rows[i], doc[i], width)
        found.append((i[e], a, z))
    return tuple(np.concatenate(x) for x in zip(*found))


def _of_bucket(key, rows, doc, width):
    """(entry, from, to) of the bytes that repeats with earlier documents cover."""
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{width + 1}").ravel(), kind="stable")]
    order = order[np.argsort(key[order], kind="stable")]
    k, r, d = key[order], rows[order], doc[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_key | np.concatenate(([True], (r[1:] != r[:-1]).any(axis=1)))
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    later = d > d[first][of]
    size = r[:, width].astype(np.int64)
    e = [order[later]]
    a, z = [np.zeros(later.sum(), np.int64)], [size[later]]
    # anchors with different surroundings: their suffixes are compared
    group = np.cumsum(new_key[first])
    many = np.bincount(group)[group] > 1
    reps, rep_group = first[many], group[many]
    if len(reps):
        work = np.cumsum(np.maximum(size[reps] - LEAST + 1, 1))
        start = np.concatenate(([True], rep_group[1:] != rep_group[:-1]))
        part = (work // AT_ONCE)[np.maximum.accumulate(np.where(start, np.arange(len(reps)), 0))]  # groups stay whole
        equal_first = np.flatnonzero(~later)
        for _, x, y in _cuts(part):
            i = reps[x:y]
            row, lo, hi = covered(r[i, :width], size[i], d[i], width)
            # entries with the same surroundings and the same document get the same
            own = np.searchsorted(of[equal_first], of[i[row]], side="left"), np.searchsorted(of[equal_first], of[i[row]], side="right")
            n = own[1] - own[0]
            m = equal_first[np.repeat(own[0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            e.append(order[m])
            a.append(np.repeat(lo, n))
            z.append(np.repeat(hi, n))
    return np.concatenate(e), np.concatenate(a), np.concatenate(z)


def _removed(p: pd.DataFrame, found: pd.DataFrame):
    """(id, other columns, bytes, pieces to remove as (from, to) arrays) of each of a batch's documents."""
    copies = set(zip(found.loc[found["copy"], "doc"].tolist(), found.loc[found["copy"], "tid"].tolist()))
    packs = [np.frombuffer(x, np.int64).reshape(4, -1) for x in found["pieces"] if x is not None and len(x)]
    doc, tid, start, end = merged(*np.concatenate(packs, axis=1)) if packs else (np.zeros(0, np.int64),) * 4
    edges = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1])))) if len(doc) else []
    spans = {(int(doc[x]), int(tid[x])): (start[x:y], end[x:y]) for x, y in zip(edges, np.append(edges[1:], len(doc)))} if len(doc) else {}
    none = (np.zeros(0, np.int64),) * 2
    for d, t, data, more in zip(p["doc"].tolist(), p["tid"].tolist(), p["data"], p["more"]):
        if (d, t) in copies:
            cut = (np.array([0]), np.array([len(data)])) if len(data) >= LEAST else none
        else:
            cut = spans.get((d, t), none)
        yield d, more, data, cut


def kept_bytes(data: bytes, cut) -> bytes:
    at, out = 0, []
    for a, z in zip(cut[0].tolist(), cut[1].tolist()):
        out.append(data[at:a])
        at = z
    return b"".join([*out, data[at:]])


def _by_batch(df: DataFrame, n: int):
    """``df`` grouped by batch, under columns of its own (both sides of a cogroup come from one table)."""
    return df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(n, "batch").groupBy("batch")


def remove_repeats(docs: DataFrame, output: str = "digest", batch_bytes: int = BATCH, hot: int = HOT) -> DataFrame:
    """Remove each byte of a text that a string of ``LEAST`` bytes covers which also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id and text; texts are taken as UTF-8 bytes, whole, and no string crosses documents.
    ``output`` 'digest': (doc_id, n_bytes, n_removed, n_spans, kept_sha256); 'documents': the columns of
    ``docs`` with what is left as text (a character that a cut has split is dropped) and, if there is one,
    n_chars to match.

    Exact copies of earlier documents go as a whole. For the rest see the head of this module: anchors that
    two documents have are found by hashes, and decided on by the bytes around them, so hashes that agree by
    chance change nothing. Batches hand on each key once, so no bucket gets more than an entry a batch for
    it, and very frequent anchors are looked up by each window that holds them.

    Nulls: a null text is empty; a null doc_id counts as larger than all others and comes out null. Rows with
    equal ids remove nothing from each other; repeated rows get equal results. Empty in, empty out.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    total = d.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    batches, buckets = max(1, math.ceil(total / batch_bytes)), max(n, math.ceil(total / BUCKET))
    tid, batch = F.xxhash64("data"), F.pmod(F.xxhash64("doc", "data"), F.lit(batches)).cast("int").alias("batch")
    n_batch = max(n, min(batches, 20_000)) if batches > n else n
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if output == "documents" else []
    more = F.to_json(F.struct(*others)) if others else F.lit("{}")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"), more.alias("more"))
    texts = texts.select("doc", tid.alias("tid"), "data", "more", batch).repartition(n_batch, "batch")

    small = d.select("doc", tid.alias("tid"), F.sha2("data", 256).alias("sha"), batch)
    # a table of its own (a hash and an id for each text that has copies), so that a large group of copies is split in the join
    least = written(small.groupBy(F.col("sha").alias("__sha")).agg(F.min("doc").alias("__least"), F.max("doc").alias("__most")).where("__most > __least").select("__sha", "__least"))
    copies = small.join(least, F.col("sha") == F.col("__sha")).where("doc > __least").select("batch", "doc", "tid")

    keys = texts.groupBy("batch").cogroup(_by_batch(copies, n_batch)).applyInPandas(_keys(buckets), KEYS)
    flags = keys.repartition(n, "bucket").groupBy("bucket").applyInPandas(_flags(hot), FLAGS)
    none = F.lit(None)  # for binaries only: pandas would make doubles of longs with nulls
    copy_flags = copies.select("batch", F.lit(-1).alias("bucket"), none.cast("binary").alias("flags"), "doc", "tid")
    flags = flags.select("batch", "bucket", "flags", F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("tid")).unionByName(copy_flags)
    entries = texts.groupBy("batch").cogroup(_by_batch(flags, n_batch)).applyInPandas(_entries(buckets), ENTRIES)
    pieces = entries.repartition(n, "bucket").groupBy("bucket").applyInPandas(_pieces(), PIECES)
    found = pieces.select("batch", "pieces", F.lit(False).alias("copy"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("tid")).unionByName(
        copies.select("batch", none.cast("binary").alias("pieces"), F.lit(True).alias("copy"), "doc", "tid")
    )
    groups = texts.groupBy("batch").cogroup(_by_batch(found, n_batch))

    def digest(p, found):
        rows = []
        for d, _, data, cut in _removed(p, found):
            rows.append((None if d == LAST else d, len(data), int((cut[1] - cut[0]).sum()), len(cut[0]), hashlib.sha256(kept_bytes(data, cut)).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    def left(p, found):
        rows = [(None if d == LAST else d, kept_bytes(data, cut).decode("utf-8", "ignore"), more) for d, more, data, cut in _removed(p, found)]
        return pd.DataFrame(rows, columns=["doc_id", "text", "more"]).astype({"doc_id": "Int64"})

    if output == "documents":
        out = groups.applyInPandas(left, "doc_id long, text string, more string")
        if others:
            out = out.withColumn("more", F.from_json("more", docs.select(*others).schema))
        length = {"n_chars": F.length("text").cast("long")} if "n_chars" in others else {}
        return out.select([length.get(c, F.col(f"more.{c}") if c in others else F.col(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return groups.applyInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
