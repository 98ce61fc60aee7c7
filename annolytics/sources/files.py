"""Listing of stored parts through Hadoop's file system API, so any shared store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _statuses(spark: SparkSession, folder: str) -> list:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.listStatus(path)) if fs.exists(path) else []


def list_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders directly inside ``folder``; none where it does not exist."""
    return sorted(s.getPath().getName() for s in _statuses(spark, folder) if s.isDirectory())


def list_batches(spark: SparkSession, folder: str, finished_only: bool = True) -> list[tuple[int, str]]:
    """(batch number, path) of every ``batch=N`` folder, by default of those that carry the mark of a finished job."""
    found = []
    for status in _statuses(spark, folder):
        name, path = status.getPath().getName(), status.getPath().toString()
        if name.startswith("batch=") and (not finished_only or any(s.getPath().getName() == "_SUCCESS" for s in _statuses(spark, path))):
            found.append((int(name.removeprefix("batch=")), path))
    return sorted(found)
