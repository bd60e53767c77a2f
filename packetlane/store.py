"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees a job's shuffle files when the job ends: what it made is in a table by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where it may be unset, a folder below the warehouse."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return got or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/packetlane-checkpoints"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and the file system that holds it, local or remote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


@contextmanager
def shuffles_freed(spark: SparkSession):
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df, computed once, written as Parquet and read again: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/packetlane-{uuid.uuid4().hex}"
    w = df.write.partitionBy(partition_by) if partition_by else df.write
    with shuffles_freed(spark):
        w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def renamed(table: DataFrame, view: DataFrame) -> DataFrame:
    """view, for which `dropped` now deletes the written table that it reads."""
    if table in _PATHS:
        _PATHS[view] = _PATHS.pop(table)
    return view


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to run reads them."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path is not None:
            p, fs = file_system(t.sparkSession, path)
            fs.delete(p, True)
