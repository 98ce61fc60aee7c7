"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside a task: bounds the Python objects alive beside an Arrow batch.
ROWS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [text or "" for text in column_of(batch, name)]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spread_out(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores out to all cores; others pass untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_by_hash(df: DataFrame, hashed: Column, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows with the smallest hash, or a few less of very many.

    A count and a cut of the hash range come first: a top k over all rows would bring k rows of each task together.
    """
    marked = df.withColumn("_hash", hashed)
    rows = marked.count()
    share = (most + 6 * most**0.5) / max(rows, 1)
    if share < 1:
        marked = marked.where(F.col("_hash") < int(share * 2**64) - 2**63)
    return marked.orderBy("_hash", *ties).limit(most).drop("_hash")
