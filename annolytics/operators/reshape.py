"""Wide, long and nested forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions.text import snake_names
from annolytics.operators.relational import lookup
from annolytics.session import materialize


def wide(df: DataFrame, item: Sequence[str], rater: str, values: Sequence[str], raters: Sequence) -> DataFrame:
    """One row per item with ``value_rater`` columns for a given rater list.

    Plain conditional aggregates: one shuffle, combined on the map side, and no job to find the pivot values.
    """
    cells = [
        F.max(F.when(F.col(rater) == r, F.col(v))).alias(name)
        for v in values
        for r, name in zip(raters, snake_names([f"{v}_{r}" for r in raters]), strict=True)
    ]
    return df.groupBy(*item).agg(*cells)


def long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def explode_labels(df: DataFrame, labels: str, name: str, keep_empty: bool) -> DataFrame:
    """One row per label of a list column; rows without labels stay (as null) when ``keep_empty``."""
    generator = F.explode_outer if keep_empty else F.explode
    return df.select(*[c for c in df.columns if c != labels], generator(labels).alias(name))


def lump_rare(df: DataFrame, label: str, n: int, other: str = "Other") -> DataFrame:
    """Keep the labels whose count ranks in the top ``n`` (ties share the lowest rank); the rest become ``other``.

    A label keeps its name exactly when its count is no lower than the n-th largest, so a top-n of the counts is
    enough and no window runs over the label table.
    """
    counts = materialize(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "label-counts")
    top = [r["_n"] for r in counts.orderBy(F.desc("_n")).limit(n).collect()]
    least = top[-1] if top else 0
    kept = counts.where(F.col("_n") >= least).select(label, F.lit(True).alias("_kept"))
    joined = lookup(df, kept, label)
    lumped = F.when(F.col("_kept") | F.col(label).isNull(), F.col(label)).otherwise(F.lit(other))
    return joined.withColumn(label, lumped).drop("_kept").select(*df.columns)


def presence(
    df: DataFrame, item: Sequence[str], rater: str, label: str, labels: Sequence[str], all_raters: Sequence[str] = ()
) -> DataFrame:
    """0/1 presence of each listed label for every observed (item, rater), long.

    With ``all_raters`` the pairs that were not observed count as 0 too (otherwise they stay absent).
    """
    seen = df.groupBy(*item, rater).agg(F.collect_set(F.when(F.col(label).isin(list(labels)), F.col(label))).alias("_set"))
    if all_raters:
        maps = F.map_from_entries(F.collect_list(F.struct(rater, "_set")))
        listed = F.array(*[F.lit(r) for r in all_raters])
        empty = F.array().cast("array<string>")
        seen = (
            seen.where(F.col(rater).isin(list(all_raters)))
            .groupBy(*item)
            .agg(maps.alias("_by_rater"))
            .withColumn(rater, F.explode(listed))
            .withColumn("_set", F.coalesce(F.try_element_at("_by_rater", F.col(rater)), empty))
            .drop("_by_rater")
        )
    exploded = seen.withColumn(label, F.explode(F.array(*[F.lit(x) for x in labels])))
    return exploded.withColumn("present", F.array_contains("_set", F.col(label)).cast("int")).drop("_set")


def simplify_variants(df: DataFrame, *columns: str) -> DataFrame:
    """Turn columns of JSON scalars into typed columns: boolean, double or string.

    The types are settled by one aggregate over all the columns; JSON null becomes null. A column with values that are no
    scalar stays as it is.
    """
    tests = []
    for i, column in enumerate(columns):
        text = F.col(column)
        is_null = text.isNull() | (text == "null")
        tests += [
            F.coalesce(F.bool_or(~is_null & text.rlike(r"^\s*[\[{]")), F.lit(False)).alias(f"nested{i}"),
            F.coalesce(F.bool_and(is_null | text.isin("true", "false")), F.lit(True)).alias(f"logical{i}"),
            F.coalesce(F.bool_and(is_null | text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")), F.lit(True)).alias(f"number{i}"),
        ]
    kinds = df.agg(*tests).first()
    out = {}
    for i, column in enumerate(columns):
        if kinds[f"nested{i}"]:
            continue
        text = F.col(column)
        value: Column = F.when(~(text.isNull() | (text == "null")), text)
        if kinds[f"logical{i}"]:
            out[column] = value.try_cast("boolean")
        elif kinds[f"number{i}"]:
            out[column] = value.try_cast("double")
        else:
            out[column] = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), value)
    return df.withColumns(out) if out else df


def rename_snake(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def select_prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c.startswith(prefix)])
