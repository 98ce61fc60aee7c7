"""One row per key, with the tie-break always spelt out.

``row_number() = 1`` is planned with a group limit ahead of the shuffle: every task passes on one row per key it holds,
so a key with a third of all rows never travels to one task as a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first by ``order``, nulls last; give enough order columns to make it unique."""
    ranks = [F.col(o).asc_nulls_last() if isinstance(o, str) else o.asc_nulls_last() for o in order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranks))
    return df.withColumn("_place", place).where(F.col("_place") <= 1).drop("_place")


def best_scored_per_key(df: DataFrame, keys: Sequence[str], score: str, below: float, tie: Sequence[str]) -> DataFrame:
    """Lowest-score row per key, kept only when that score is under ``below``."""
    return first_per_key(df, keys, [score, *tie]).where(F.col(score) < below)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
