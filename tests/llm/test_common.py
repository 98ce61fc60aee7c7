"""Shared helpers."""

import pytest
from annolytics.llm.common import first_by_hash
from pyspark.sql import functions as F


@pytest.mark.parametrize("rows", [0, 50, 100, 130, 5000])
def test_first_by_hash_is_the_smallest_hashes(spark, rows):
    df = spark.range(rows)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert [r.id for r in first_by_hash(df, F.xxhash64("id"), 100, "id").collect()] == want
