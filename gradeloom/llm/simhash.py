"""SimHash near-duplicates: fingerprints of word shingles, and links found in a grid of segment bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Forest, cut, partitions
from gradeloom.llm.components import components

SHINGLE = 3
SEED = 42
#: 16 segments of 4 bits: a fingerprint becomes 16 counts from 0 to 4, about 2^32 cells that are in use.
SEGMENTS = 16
#: Hashes are counted in blocks of this many shingles, so a long text needs no more memory than a block.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the text's word shingles (0 without words); unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: 1 - SHINGLE - 1]))
    stops = ends[SHINGLE - 1 :] - 1
    n, ones = len(starts), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist())), np.uint64, min(BLOCK, n - at))
        ones += bit_counts(h)
    bits = np.flatnonzero(2 * ones > n)
    return int(sum(1 << int(b) for b in bits))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(h: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have set, as a signed long; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += bit_counts(h[at : at + BLOCK])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for b in batches:
        fps = [fingerprint(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bits set in each of the segments, one row a fingerprint."""
    width = 64 // SEGMENTS
    shifts = np.arange(0, 64, width, dtype=np.uint64)
    return np.bitwise_count((fp[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int8)


def cell_key(counts: np.ndarray) -> np.ndarray:
    """One long for each row of counts: 4 bits a segment, without loss."""
    shifts = np.arange(0, 4 * SEGMENTS, 4, dtype=np.uint64)
    return (counts.astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)


def _to_cells(batches):
    """Each fingerprint goes to its own cell and to those one count away.

    Differing in 2 bits at most, two fingerprints have counts at a Manhattan distance of 2 at most, and then
    some cell is within 1 of both.
    """
    width = 64 // SEGMENTS
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        counts = segment_counts(fp)
        own = cell_key(counts)
        keys, fps = [own], [fp]
        for s in range(SEGMENTS):
            one = np.uint64(1 << (4 * s))
            up, down = counts[:, s] < width, counts[:, s] > 0
            keys += [own[up] + one, own[down] - one]
            fps += [fp[up], fp[down]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64))], ["cell", "fp"])


def _links_of_cells(distance):
    def run(batches):
        kept = None
        for b in batches:
            cell, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            if kept is not None:
                cell, fp = np.concatenate((kept[0], cell)), np.concatenate((kept[1], fp))
            whole = np.searchsorted(cell, cell[-1]) if len(cell) else 0  # the last cell may go on in the next batch
            kept = cell[whole:], fp[whole:]
            yield _links(cell[:whole], fp[:whole].view(np.uint64), distance)
        if kept is not None:
            yield _links(kept[0], kept[1].view(np.uint64), distance)

    return run


def _links(cell: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    """All pairs of each cell are compared; of the links, those that join two parts of a cell's forest go out."""
    a, b = [], []
    n, gap, forest = len(cell), 1, None
    alive = np.arange(n - 1) if n > 1 else np.empty(0, np.int64)
    while len(alive):
        alive = alive[alive + gap < n]
        alive = alive[cell[alive] == cell[alive + gap]]
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + gap]) <= distance]
        if len(near):
            forest = forest or Forest(n)
            for i in near.tolist():
                if forest.join(i, i + gap):
                    a.append(i)
                    b.append(i + gap)
        gap += 1
    f = fp.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(f[np.array(a, np.int64)]), pa.array(f[np.array(b, np.int64)])], ["a", "b"])


def near_fingerprints(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links that join what differs in ``distance`` bits or less, of the distinct fingerprints ``fps`` (fp long)."""
    cells = fps.select("fp").mapInArrow(_to_cells, "cell long, fp long")
    return cells.repartition(partitions(fps.sparkSession), "cell").sortWithinPartitions("cell", "fp").mapInArrow(_links_of_cells(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns are not used).

    Documents link when their fingerprints differ in at most ``distance`` (up to 2) bits; component_id is the
    smallest doc_id that links reach. Equal fingerprints are one row of the search. Each distinct fingerprint
    is put into its cell of the grid of segment bit counts and the cells around it; the Manhattan distance of
    counts is a lower bound of the differing bits, so that no link is lost, and pairs that meet are verified.

    Nulls: a null text has no words; texts without words share the fingerprint zero and link. A null doc_id
    keeps its row and takes part, but is no component_id unless its whole component has none. Repeated rows
    come out each. Empty in, empty out.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the cells of this grid cover distances up to 2")
    fps = cut(fingerprints(docs))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut(components(near_fingerprints(classes, distance)))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = linked.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(of_class, fps["fp"] == of_class["__fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
