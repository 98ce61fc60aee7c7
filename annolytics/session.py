"""Session set-up and the shared folder that written intermediates go to."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "annolytics", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. On a cluster leave ``master`` unset: spark-submit supplies it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="annolytics-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without that setting; it gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_scratch()
    raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/annolytics/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go with its end, or they would pile up until the driver collects garbage.
    """
    path = new_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each query run inside deletes its shuffle files at its end, for loops that would pile them up pass by pass."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*stored: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames. Call it once nothing unevaluated reads them."""
    for df in stored:
        spark = df.sparkSession
        ours = f"{shared_dir(spark)}/annolytics/"
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if ours.split(":", 1)[-1].lstrip("/") not in folder:
                raise ValueError(f"{folder} is no stored intermediate")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Rows and bytes a side may hold before it is no longer broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy work on few, large input splits a task per core; inputs with enough splits pass untouched.

    Rows are hashed by ``key``, so a later grouping on it needs no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def by_document(df: DataFrame, key: str) -> DataFrame:
    """Hash whole documents by ``key``, so that what is exploded from them is grouped by document without a further shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after a pass, cut off at the bound on rows, proves ``df`` small in rows and bytes."""
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
