"""Reliable checkpoints in the folder that the session names, and joins by a checked size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000

#: Checkpoints are read in partitions of about this size, so that small ones take few tasks.
PARTITION_BYTES = 8 << 20

#: A checkpoint of at most this size may be broadcast.
BROADCAST_BYTES = 16 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of the context.

    The session's ``spark.checkpoint.dir`` holds if it is set.  A folder of this
    machine is chosen in local mode only; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "skein-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, path: str) -> None:
    at, files = files_of(spark, path)
    files.delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder; its lineage ends there.

    The result's ``checkpoint_file`` and ``checkpoint_bytes`` say where it is and how large.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    out = df.checkpoint(eager=True)
    rdd = out._jdf.queryExecution().logical().rdd()
    file = rdd.getCheckpointFile()
    path = file.get() if file.isDefined() else None  # an empty table needs none
    size = 0
    if path:
        at, files = files_of(spark, path)
        size = files.getContentSummary(at).getLength()
    parts = 1 + size // PARTITION_BYTES
    packed = out.coalesce(parts) if parts < rdd.getNumPartitions() else out
    packed.checkpoint_file, packed.checkpoint_bytes = path, size
    return packed


def release(*tables: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in tables:
        if df.checkpoint_file:
            deleted(df.sparkSession, df.checkpoint_file)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its checkpoint is known to be small or else it has at most ``rows`` rows; as it is otherwise."""
    size = getattr(df, "checkpoint_bytes", None)
    small = size <= BROADCAST_BYTES if size is not None else df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df
