"""What the operators of this subpackage share."""

from __future__ import annotations

import math
import pickle
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and return it with its lineage cut.

    The folder is the one that the session names in spark.checkpoint.dir. A folder of this machine is taken
    only where none is set and the session is a local one, as in tests; on a cluster that is an error, for
    other machines could not read it. Spark deletes checkpoints that nothing refers to any more where the
    session sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers that are worth a task.
ROWS_A_TASK = 100_000


def fitted(df: DataFrame, rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` in as many tasks as about ``rows`` rows are worth, all cores at least; where that is over half the shuffle partitions, as it is.

    Else each of many rounds over a small table costs a task, a shuffle file and a checkpoint file for each of the
    shuffle partitions. Adaptive execution does the same after a shuffle, where it may, but not for checkpoints.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, math.ceil(rows / a_task))
    return df.coalesce(n) if 2 * n <= partitions(spark) else df


def is_finite(c: Column) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def usable_vector(c: Column) -> Column:
    """Vectors that take part in searches: not null, no null or non-finite component, not all zero."""
    return F.coalesce(c.isNotNull() & F.forall(c, is_finite) & F.exists(c, lambda x: x != 0), F.lit(False))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def sorted_runs(batches, keys):
    """Of Arrow batches sorted by ``keys`` (no nulls): (table, [(first, last + 1), ...]), every run of equal keys once and whole.

    A task holds one batch and the run that its end has cut, so runs need a bound.
    """
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = t[k].to_numpy()
            change |= c[1:] != c[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist()]
        if len(at) > 1:
            yield t, list(zip(at[:-1], at[1:]))
        held = t.slice(at[-1])
    if held is not None:
        yield held, [(0, held.num_rows)]


class Forest:
    """Union-find over the integers 0..n-1; a root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True


class Shipped:
    """An object of this package, of a fixed or checked size, that tasks read from a broadcast."""

    def __init__(self, spark: SparkSession, thing):
        self.box = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def get(self):
        return pickle.loads(self.box.value)
