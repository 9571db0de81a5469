"""Intermediate tables in the cluster's shared folder.

A staged table is written once as Parquet under the folder that ``spark.checkpoint.dir`` names, then read back: its lineage
ends there, so the loss of an executor never means a second run of what made it, and every executor can read it. Folders
are removed when the session's process ends, or earlier by ``discard``.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and the master is local."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"spindrift-{os.getpid()}")


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, *partition_by: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files behind tables that have been written: it does so once the driver's collectors find
    that no plan refers to them, which a driver with little to do may not find for an hour. To be called between the phases
    of a long operator."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    for path in list(_WRITTEN):
        if any(path.split("/")[-1] in f for f in df.inputFiles()):
            _remove(_WRITTEN.pop(path), path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session is gone; the cluster's own cleaning takes over
            return
