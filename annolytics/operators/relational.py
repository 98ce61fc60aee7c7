"""Joins and unions whose shape survives hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from annolytics.session import broadcast_if_small

HOT_SHARE = 0.001  # a key above this share of all rows is salted, so at most 1,000 keys are
LEAST_HOT = 1000  # rows of a key that are never worth parting


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets null keys meet, keeping one copy of the keys."""
    cond = None
    for key in keys:
        term = left[key].eqNullSafe(right[key])
        cond = term if cond is None else cond & term
    joined = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    for key in keys:
        joined = joined.drop(right[key])
    return joined


def lookup(facts: DataFrame, dim: DataFrame, keys: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Attach a dimension; broadcast only when its counted size is within the bound."""
    return facts.join(broadcast_if_small(dim), on=keys, how=how)


def key_counts(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))


def salted_lookup(
    facts: DataFrame, dim: DataFrame, key: str, counts: DataFrame | None = None, how: str = "left"
) -> DataFrame:
    """Attach one ``dim`` row per key when few keys hold many of the facts.

    A key above ``HOT_SHARE`` of all facts gets a sub-key for each such share that it holds, so no sub-key has more than
    about that share, and its ``dim`` row is copied to each of them; all hot keys together have at most 2/HOT_SHARE
    sub-keys, so their list is broadcast. Null keys meet nothing: their facts are spread by a hash of the other columns.
    """
    counts = key_counts(facts, key) if counts is None else counts
    counts = counts.where(F.col(key).isNotNull())
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(total * HOT_SHARE, LEAST_HOT)
    hot = counts.where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    hot = F.broadcast(hot)
    others = [c for c in facts.columns if c != key]
    own = F.xxhash64(*others) if others else F.lit(0).cast("long")
    spread = F.when(F.col(key).isNull(), own).otherwise(F.pmod(own, F.coalesce(F.col("_salts"), F.lit(1)).cast("long")))
    left = facts.join(hot, key, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1))
    right = dim.where(F.col(key).isNotNull()).join(hot, key, "left").withColumn("_salt", copies).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def cross_with_dimension(items: DataFrame, rows: Sequence[Row | Mapping], schema: str) -> DataFrame:
    """Every item with every row of a driver-side dimension, as a generator: no join and no shuffle."""
    spark = items.sparkSession
    fields = spark.createDataFrame([], schema).schema.fields
    records = [r.asDict() if isinstance(r, Row) else dict(r) for r in rows]
    structs = [
        F.struct(*[_literal(rec.get(f.name)).cast(f.dataType).alias(f.name) for f in fields]) for rec in records
    ]
    return items.select("*", F.inline(F.array(*structs)))


def _literal(value) -> Column:
    if isinstance(value, Mapping):
        flat = [F.lit(part) for pair in value.items() for part in pair]
        return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
    return F.lit(value)


def union_tagged(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with the part's name in column ``tag``; missing columns become null."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys`` (semi-join)."""
    return df.join(keys.select(*on), list(on), "left_semi")


def unfinished(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``work`` that have no stored result yet (anti-join)."""
    return work.join(done.select(*on), list(on), "left_anti")


