"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt out by columns to a fixed number of partitions, that of the session's shuffles.

    Tables that are dealt out so aren't dealt again by joins on just these columns; a number that Spark fits to the data
    would differ between them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, worked out at once and held on the executors' disks until the block ends.

    Unlike a table that is ``written`` it is still known to be dealt out and sorted as it was; what an executor loses is made
    again. What outlives the block has to be written within it.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        held.count()
        yield held
    finally:
        held.unpersist()


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the folder that the session names in spark.checkpoint.dir, with a short plan that reads it.

    For tables that several later steps read: each would carry the whole plan before it otherwise. Without a
    setting a folder of this machine is taken in local sessions; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint()
