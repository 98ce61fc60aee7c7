"""Numbering, running totals, top-k and bins without a single-task window over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.operators.relational import join_on
from annolytics.session import materialize


def _lay_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-partition and sort by ``keys``, and store the slice and place of each row.

    The result is written: range bounds are sampled, so a second evaluation could cut the slices elsewhere.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(
        ranged.withColumn("_slice", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()),
        "slices",
    )


def number_rows(
    df: DataFrame, order: Sequence[str], partition: Sequence[str] = (), name: str = "row_number"
) -> DataFrame:
    """``row_number`` over a total order, in two passes: place inside the slice, plus rows in earlier slices.

    Only the table of slice sizes (one row per slice and group) is windowed; the data itself is sorted in parallel,
    so one group may hold any share of the rows.
    """
    laid = _lay_out(df, [*partition, *order])
    spans = laid.groupBy("_slice", *partition).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    earlier = Window.partitionBy(*partition).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    number = (F.col("_before") + F.col("_place") - F.col("_start") + 1).cast("long")
    return join_on(laid, spans, ["_slice", *partition]).withColumn(name, number).select(*df.columns, name)


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` over a total order, in two passes like :func:`number_rows`."""
    laid = _lay_out(df.withColumn("_v", value.cast("long")), order)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("_slice").agg(F.sum("_v").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    # ``sums`` has one row per slice, so its size is bounded by the number of partitions
    inside = Window.partitionBy("_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_v").over(inside) + F.col("_before")
    return laid.join(F.broadcast(sums), "_slice").withColumn(name, total).select(*df.columns, name)


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, shares: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles of ``value`` per group, between neighbours by straight line; one column for each of ``shares``.

    Distinct values are counted and numbered in sorted order over all tasks, and each order statistic is then the value
    whose numbers enclose its place. No group is sorted, or held, in one task. ``weight`` counts a row several times.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    names = [f"_g{i}" for i in range(len(groups))]
    known = df.where(F.col(value).isNotNull()).select(
        *[F.col(g).alias(a) for g, a in zip(groups, names)], F.col(value).cast("double").alias("_x"), *([weight] if weight else [])
    )
    counts = known.groupBy(*names, "_x").agg(n.cast("long").alias("_c"))
    through = running_total(counts, [*names, "_x"], F.col("_c"), "_through")
    totals = through.groupBy(*names).agg(F.sum("_c").alias("_all"), F.min(F.col("_through") - F.col("_c")).alias("_before"))
    placed = join_on(through, totals, names) if names else through.withColumns(
        {c: totals.select(c).scalar() for c in ("_all", "_before")}
    )
    end = F.col("_through") - F.col("_before")
    cells = []
    for i, share in enumerate(shares.values()):
        place = (F.col("_all") - 1) * F.lit(share)
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            cells.append(F.max(F.when((end - F.col("_c") <= at) & (at < end), F.col("_x"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*names).agg(F.max("_all").alias("_all"), *cells)
    out = []
    for i, (name, share) in enumerate(shares.items()):
        place = (F.col("_all") - 1) * F.lit(share)
        out.append((F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (place - F.floor(place))).alias(name))
    return found.select(*[F.col(a).alias(g) for g, a in zip(groups, names)], *out)


def batch_ids(
    df: DataFrame, order: Sequence[str], size: int | str, partition: Sequence[str] = (), name: str = "batch"
) -> DataFrame:
    """Fixed-size batch number from 1, over all rows or per group; ``size`` is a number or a column."""
    width = F.col(size) if isinstance(size, str) else F.lit(size)
    numbered = number_rows(df, order, partition, "_rn")
    return numbered.withColumn(name, (F.floor((F.col("_rn") - 1) / width) + 1).cast("long")).drop("_rn")


def with_group_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Attach group aggregates to every row: partial aggregate, then a join AQE may split when a key is hot."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return join_on(df, sums, keys)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Top ``k`` rows per group. The rank filter is also applied before the shuffle, so a group sends k rows per task."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def equal_width_bins(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed equal-width bin number, 1 to ``bins``. The minimum falls in bin 1; equal values fall in the middle."""
    raw = F.ceil(F.try_divide(x - low, (high - low) / bins)).cast("int")
    inside = F.greatest(F.lit(1), F.least(F.lit(bins), raw))
    return F.when(high > low, inside).when(x.isNotNull(), F.lit((bins + 1) // 2))


def cut_counts(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Counts per equal-width bin. Values are counted first and stored, so the range is taken from the small table."""
    counts = materialize(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n")), "values")
    bounds = counts.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    if bounds["low"] is None:
        return counts.select(F.lit(None).cast("int").alias("bin"), "n").limit(0)
    bin_no = equal_width_bins(F.col(x), F.lit(float(bounds["low"])), F.lit(float(bounds["high"])), bins)
    return counts.groupBy(bin_no.alias("bin")).agg(F.sum("n").alias("n"))


def first_maximum(df: DataFrame, key: str, score: str, fallback: int) -> DataFrame:
    """Smallest key with the highest score, or ``fallback`` when no score is above zero."""
    best = F.max_by(F.col(key), F.struct(F.col(score), -F.col(key)))
    return df.agg(F.when(F.coalesce(F.max(score), F.lit(0)) > 0, best).otherwise(F.lit(fallback)).alias(key))


def letter_aliases(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Letters for the distinct values in sorted order: A to Z, then AA, AB and so on."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = number_rows(values, [column], name="_n")
    start = F.struct(F.col("_n").cast("long").alias("left"), F.lit("").alias("text"))

    def digit(state: Column, _: Column) -> Column:
        letter = F.char((F.lit(65) + F.pmod(state["left"] - 1, F.lit(26))).cast("int"))
        more = state["left"] > 0
        return F.struct(
            F.when(more, F.floor((state["left"] - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("left"),
            F.when(more, F.concat(letter, state["text"])).otherwise(state["text"]).alias("text"),
        )

    digits = F.sequence(F.lit(1), F.lit(14))  # enough for any long
    return numbered.select(F.col(column).cast("string").alias(column), F.aggregate(digits, start, digit)["text"].alias(alias))
