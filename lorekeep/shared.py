"""Cutting lineage through storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []  # what ``scratch`` has handed out


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only on a single machine where none is configured (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lorekeep-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cut(df: DataFrame, parts: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: what follows forgets how it was made.

    Unlike a checkpoint, a table has sizes of its own. A checkpoint keeps the estimates of the plan it
    cut, and in an iteration of joins these are multiplied until they fill the driver's memory.
    ``parts``: a column of few values to divide the table by, so that a filter on it reads only what it keeps.
    """
    path = scratch(df.sparkSession, "cut")
    (df.write.partitionBy(parts) if parts else df.write).parquet(path)
    order = [c for c in df.columns if c != parts] + ([parts] if parts else [])
    out = df.sparkSession.read.schema(df.select(*order).schema).parquet(path)
    if parts:
        out = out.select(*df.columns)
    out._scratch_path = path
    return out


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file into the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def purge(spark: SparkSession) -> None:
    """Delete all that this process has put into the shared folder. Results that still read from it must have been written."""
    while _MADE:
        remove(spark, _MADE.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables made by ``cut`` that nothing reads any more; with ``part`` (``column=value``) only that part of them."""
    for df in tables:
        if path := df.__dict__.get("_scratch_path"):
            remove(df.sparkSession, f"{path}/{part}" if part else path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only where the scan gives fewer tasks than the cluster has cores.

    Splittable input comes in enough partitions by itself; one file with one row group does not,
    and a CPU-bound map over it would then run in a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys) if keys else df.repartition(2 * cores)
