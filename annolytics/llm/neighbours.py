"""Bring every row together with its neighbour in a global order, moving each row once.

The order is cut into slices at values of the key itself, so the first row of a slice is known before anything moves:
it is sent to its own slice and, as the neighbour of the last row there, to the slice before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Slices for each shuffle partition; several even out what hashing slices to partitions leaves uneven.
SLICES_PER_TASK = 4


def cuts(df: DataFrame, key: str, count: int) -> list:
    """At most ``count`` values of the key, ascending, its largest among them: the first rows of the slices when
    the order descends. Numbers are sketched in one pass over the key column alone; of texts about twenty rows a
    slice are drawn. Where the cuts fall has no influence on any result."""
    if dict(df.dtypes)[key] == "string":
        rows, largest = df.agg(F.count(key), F.max(key)).first()
        drawn = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, 20 * count / max(rows, 1)), 7)
        found = sorted(r[0] for r in drawn.limit(40 * count).collect())
        return sorted({*found[:: max(1, len(found) // count)], largest} - {None})
    shares = [i / count for i in range(1, count)]
    row = df.agg(F.percentile_approx(key, F.lit(shares), F.lit(50 * count)).alias("c"), F.max(key).alias("m")).first()
    return sorted({*(row.c or []), row.m} - {None})


def place_among(bounds: list):
    """Twice the number of bounds below a key, and one more where the key is a bound itself; by bisection."""
    ordered = np.array(bounds, dtype=object if isinstance(bounds[0], str) else None)

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        own = keys.to_numpy()
        below = np.searchsorted(ordered, own, side="left")
        return pd.Series(2 * below + (np.searchsorted(ordered, own, side="right") > below))

    return place


def with_next(
    df: DataFrame, key: str, tie: str, work: Callable[[Iterator[tuple[dict, dict | None]]], Iterator[dict]],
    out: StructType, *, wrap: bool = True, group: str | None = None,
) -> DataFrame:
    """Apply ``work`` to the pairs (row, next row) of every task, by descending ``key`` and ascending ``tie``.

    After the last row comes the first (``wrap``) or none. A row with a null key has no place in the order and no
    next row; such rows are dealt out by their ``tie``. A key repeated on many rows keeps those rows in one slice.

    With ``group``, a column whose values lie side by side in the order, the last row of a group comes straight after
    the row before it: a slice that would begin with that row begins with the first one of its group.
    """
    count = SLICES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cuts(df, key, count)
    if group is not None:
        ends = df.groupBy(group).agg(F.min(key).alias("last"), F.max(key).alias("first"))
        moved = {r["last"]: r["first"] for r in ends.where(F.col("last").isin(found)).collect()}
        found = sorted({moved.get(b, b) for b in found})
    code = place_among(found)(F.coalesce(F.col(key), F.lit(found[0]))) if found else F.lit(0).cast("long")
    df = df.withColumn("_code", code)
    own, first = F.expr("cast(_code div 2 as int)"), F.col("_code") % 2 == 1
    before = F.pmod(own + 1, F.lit(max(1, len(found))))
    lone = F.array(F.struct((-1 - F.pmod(F.xxhash64(tie), F.lit(count))).cast("int").alias("s"), F.lit(False).alias("x")))
    places = F.array(F.struct(own.alias("s"), F.lit(False).alias("x")))
    extra = F.when(
        first & ((own < len(found) - 1) | F.lit(wrap)), F.array(F.struct(before.cast("int").alias("s"), F.lit(True).alias("x")))
    ).otherwise(F.array().cast("array<struct<s:int,x:boolean>>"))
    dealt = (
        df.withColumns({"_to": F.explode(F.when(F.col(key).isNull(), lone).otherwise(F.concat(places, extra)))})
        .withColumns({"_slice": F.col("_to.s"), "_extra": F.col("_to.x")}).drop("_to", "_code")
    )
    # an extra row closes its slice; of several with that key the first in order is the next row
    laid = dealt.repartition(max(1, count // SLICES_PER_TASK), "_slice").sortWithinPartitions("_slice", "_extra", F.desc(key), tie)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict | None]]:
        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if held is not None and not held["_extra"]:
                        same = row["_slice"] == held["_slice"] and held["_slice"] >= 0
                        yield held, row if same else None
                    held = row
        if held is not None and not held["_extra"]:
            yield held, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows = None, []
        for row in work(pairs(batches)):
            rows.append(row)
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema=schema or (schema := to_arrow(out)))
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema or to_arrow(out))

    return laid.mapInArrow(run, out)


def to_arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
