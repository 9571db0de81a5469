"""Helpers that plans share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so that loops don't pile up lineage; to ``spark.checkpoint.dir`` where that is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spindrift-"))
    return df.checkpoint()


_KEPT: dict[tuple, DataFrame] = {}


def keeper(spark: SparkSession, *names: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table to the cluster's shared folder once in a session, and gives it as read from there."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        sc = spark.sparkContext
        key = (sc.applicationId, *names, name)
        if key not in _KEPT:
            where = sc.getConf().get("spark.checkpoint.dir", None)
            if where is None:
                if not sc.master.startswith("local"):
                    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
                where = tempfile.mkdtemp(prefix="spindrift-")
                atexit.register(shutil.rmtree, where, ignore_errors=True)
            path = f"{where.rstrip('/')}/kept-{uuid.uuid4().hex}"
            df.write.parquet(path)
            _KEPT[key] = spark.read.schema(df.schema).parquet(path)
        return _KEPT[key]

    return keep
