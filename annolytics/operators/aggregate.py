"""Rollups, rates, contingency tables and cost accounts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions import stats
from annolytics.operators.relational import join_on, lookup
from annolytics.operators.windows import number_rows, quantiles
from annolytics.session import materialize


def entity_rollup(chart: DataFrame, keys: Sequence[str], rank: str, date: str) -> DataFrame:
    """Weeks, best rank, and the latest year at that best rank, in one hash aggregate."""
    return chart.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"), F.min(rank).alias("top"), year_at_best(F.col(rank), F.year(date)).alias("year")
    )


YEARS_PER_RANK = 1_000_000  # more than any span of years


def year_at_best(rank: Column, year: Column) -> Column:
    """Latest year among the rows of the lowest rank, as a maximum over one number per row.

    Plain numbers keep the plan a hash aggregate; a maximum over structs would sort the rows by key first.
    """
    steps = rank.cast("long") * YEARS_PER_RANK
    return (F.max(year - steps) + F.min(steps)).cast("int")


def count_true(columns: Sequence[Column]) -> Column:
    """How many of the flags are true; null counts as false."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(c.cast("int"), F.lit(0))
    return total


def all_same(columns: Sequence[Column], value) -> Column:
    """True when every column equals ``value``; null columns make it false."""
    return F.forall(F.array(*columns), lambda c: F.coalesce(c == F.lit(value), F.lit(False)))


def item_summary(ratings: DataFrame, item: Sequence[str], flag: str, confidence: str) -> DataFrame:
    """Mean flag, mean confidence and number of true flags per item."""
    x = F.col(flag).cast("double")
    return ratings.groupBy(*item).agg(
        F.avg(x).alias("share"),
        F.avg(confidence).alias("confidence"),
        F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0)).alias("votes"),
    )


def majority(summary: DataFrame, raters: int) -> DataFrame:
    """Items with more than half of the votes."""
    return summary.where(F.col("votes") > raters / 2)


def rates(ratings: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Positive count and share of non-null flags per group."""
    return ratings.groupBy(*by).agg(
        F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0)).alias("positives"),
        F.avg(F.col(flag).cast("double")).alias("share"),
    )


def rate_range(ratings: DataFrame, by: str, flag: str) -> DataFrame:
    shares = rates(ratings, [by], flag)
    return shares.agg(F.min("share").alias("low"), F.max("share").alias("high"))


def mean_se(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and standard error of already aggregated values (one row per rater and group)."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), stats.standard_error(F.col(value)).alias("se"), F.count(value).alias("n")
    )


def weighted_rates(ratings: DataFrame, by: Sequence[str], flag: str, weight: str) -> DataFrame:
    return ratings.groupBy(*by).agg(stats.weighted_mean(F.col(flag).cast("double"), F.col(weight)).alias("share"))


def flag_rates_long(df: DataFrame, by: Sequence[str], flags: Sequence[str], name: str = "keyword") -> DataFrame:
    """Rate of every flag per group in one scan, then long."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    return wide.unpivot(list(by), list(flags), name, "rate")


def positive_counts_long(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows with a score above zero, per group and measure; groups without any are left out."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(m) > 0).alias(m) for m in measures])
    return wide.unpivot(list(by), list(measures), "measure", "n").where(F.col("n") > 0)


def max_per_entity(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Largest value per column; null only where all values are null."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def contingency(df: DataFrame, rows: str, columns: str, values: Mapping[object, str]) -> DataFrame:
    """Counts of ``rows`` by the given ``columns`` values, zero filled; ``values`` names the output columns."""
    cells = [F.count_if(F.col(columns).eqNullSafe(F.lit(v))).alias(name) for v, name in values.items()]
    return df.groupBy(rows).agg(*cells)


def label_frequency(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per label; the total is summed over the counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("percent", 100.0 * stats.ratio(F.col("n"), total.select("total").scalar()))


def shares_within(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Count of each label and its share of the group; the totals come from the counts, not from the rows."""
    counts = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    joined = counts.join(totals, list(group))
    return joined.withColumn("share", stats.ratio(F.col("n"), F.col("_total"))).drop("_total")


def histogram(df: DataFrame, by: Sequence[str], x: str, width: float) -> DataFrame:
    """Counts per bin, bins centred on multiples of ``width``."""
    index = F.floor(F.col(x) / width + 0.5).cast("long")
    return df.where(F.col(x).isNotNull()).groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overplot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def category_order(df: DataFrame, category: str, value: str) -> DataFrame:
    """Median, count and place in the order of medians (from 1, ties by name) of every category."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    found = join_on(counts, quantiles(df, [category], value, {"median": 0.5}), [category], "left")
    return number_rows(found, ["median", category], name="place")


def usage_averages(responses: DataFrame, rater: str) -> DataFrame:
    """Mean of every token column per rater, and the mean over raters of those means in the row of the null rater."""
    tokens = [c for c in responses.columns if "tokens" in c]
    each = materialize(responses.groupBy(rater).agg(F.count(F.lit(1)).alias("responses"), *[F.avg(c).alias(c) for c in tokens]), "averages")
    over = each.agg(F.sum("responses").alias("responses"), *[F.avg(c).alias(c) for c in tokens])
    return each.unionByName(over.withColumn(rater, F.lit(None).cast(each.schema[rater].dataType)))


def usage_totals(responses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of every token and cost column; sums of nothing are zero."""
    summed = [c for c in responses.columns if "tokens" in c or "cost" in c]
    return responses.groupBy(*by).agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in summed])


def estimated_costs(responses: DataFrame, pricing: DataFrame) -> DataFrame:
    """Tokens and cost per rater and mode; absent or zero costs come from list prices.

    Prices are per million tokens. Cached input has its own price; a provider may not stack the batch discount with
    the cache discount. Reported batch costs are halved.
    """
    used = lookup(usage_totals(responses, ["model", "processing"]), pricing, "model")
    million = 1e6
    price_in, price_out = F.col("input_per_m"), F.col("output_per_m")
    price_cached = F.coalesce("cached_input_per_m", price_in)
    tokens_in, cached, tokens_out = F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens")
    fresh = F.greatest(tokens_in - cached, F.lit(0.0))
    with_cache = (fresh * price_in + cached * price_cached + tokens_out * price_out) / million
    without_cache = (tokens_in * price_in + tokens_out * price_out) / million
    batched = F.when(F.coalesce("cache_discounts_with_batch", F.lit(True)), with_cache).otherwise(without_cache)
    is_batch = F.col("processing") == "batch"
    listed = F.when(is_batch, batched * F.coalesce("batch_discount_factor", F.lit(1.0))).otherwise(with_cache)
    use_listed = (F.col("cost").isNull() | (F.col("cost") == 0)) & price_in.isNotNull()
    cost = F.when(use_listed, listed).when(is_batch, F.col("cost") / 2).otherwise(F.col("cost"))
    return used.select(
        "model", "processing", "input_tokens", "cached_input_tokens", "output_tokens", cost.alias("cost")
    )


def cost_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tasks side by side per rater and mode, tokens in millions."""
    keys = ["model", "processing"]

    def scaled(df: DataFrame, suffix: str) -> DataFrame:
        tokens = [(F.col(c) / 1e6).alias(f"{c}_m{suffix}") for c in ("input_tokens", "cached_input_tokens", "output_tokens")]
        return df.select(*keys, *tokens, F.col("cost").alias(f"cost{suffix}"))

    return scaled(first, "").join(scaled(second, "_second"), keys, "left").orderBy(*keys)
