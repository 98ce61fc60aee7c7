"""Runs a plan and its SQL on the same tables and compares the rows, strictly."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return value
    return value if value is None or isinstance(value, (int, str)) else str(value)


def _kind(name: str) -> str:
    name = name.lower()
    for kind, starts in {
        "int": ("tinyint", "smallint", "int", "bigint", "hugeint", "long"), "float": ("double", "float", "decimal"),
        "bool": ("bool",), "text": ("string", "varchar"), "date": ("date",), "time": ("timestamp",),
    }.items():
        if name.startswith(starts):
            return kind
    return name


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between both results; empty when they agree in names, kinds of type and values."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _kind(str(d[1])) for d in result.description}
    theirs = result.fetchall()
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(spark_df.columns)} / {sorted(names)}"]
    for field in spark_df.schema.fields:
        kind = _kind(field.dataType.simpleString())
        if kind != kinds[field.name]:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} / {kinds[field.name]}")
    order = sorted(names)
    ours = Counter(tuple(_plain(row[c]) for c in order) for row in spark_df.collect())
    at = {n: i for i, n in enumerate(names)}
    other = Counter(tuple(_plain(row[at[c]]) for c in order) for row in theirs)
    if ours != other:
        only, missing = list((ours - other).items())[:3], list((other - ours).items())[:3]
        problems.append(f"rows {sum(ours.values())} / {sum(other.values())}; only Spark {only}; only SQL {missing}")
    return problems
