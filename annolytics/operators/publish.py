"""Releases without protected text, and manifests of what was released."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators.relational import lookup
from annolytics.operators.windows import letter_aliases


def assert_absent(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Fail when a column that must not be released is still there."""
    found = sorted(set(df.columns) & set(columns))
    if found:
        raise ValueError(f"{name} still contains excluded columns: {', '.join(found)}")
    return df


def pseudonymise(df: DataFrame, person: str, drop: Sequence[str], alias: str = "coder", prefix: str = "Coder ") -> DataFrame:
    """Replace a person column by letters in sorted order and drop the protected columns."""
    letters = letter_aliases(df, person, "_letter")
    out = lookup(df, letters, person).withColumn(alias, F.concat(F.lit(prefix), F.col("_letter")))
    gone = {person, "_letter", *drop} - {alias}
    return assert_absent(out.drop(*gone), [c for c in drop if c != alias], "pseudonymised table")


def text_features(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Flags computed from a text, without the text."""
    cleaned = df.withColumn("_clean", text.clean_text(F.col(body)))
    out = cleaned.select(*keep, text.has_text(F.col(body)).alias("has_text"), *text.keyword_flags(F.col("_clean")))
    return assert_absent(out, [body], "text features")


def content_hash(df: DataFrame):
    """Order-free hash of all rows and columns: the sum of 64-bit row hashes, so that copies do not cancel out.

    Hashing skips nulls, so each column goes in with its null flag; maps have no hash and go in as JSON.
    """
    parts = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        value = F.to_json(field.name) if field.dataType.typeName() == "map" else F.col(field.name)
        parts += [value, F.col(field.name).isNull()]
    return F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).cast("string")


def snapshot_manifest(tables: Mapping[str, DataFrame], sensitive: Sequence[str] = ()) -> DataFrame:
    """One row per table: rows, columns, files, bytes, content hash, sensitivity. Each table is read once.

    Counts and hashes are taken per file and then summed, so the size of each file counts once.
    """
    out = None
    for name, df in tables.items():
        path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        files = df.select("*", path.alias("_file"), size.alias("_size")).groupBy("_file").agg(
            F.count(F.lit(1)).alias("rows"), F.max("_size").alias("bytes"), content_hash(df).alias("content_hash")
        )
        row = files.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            F.md5(F.coalesce(F.sum(F.col("content_hash").cast("decimal(38,0)")), F.lit(0)).cast("string").cast("binary")).alias("content_hash"),
        ).select(
            F.lit(name).alias("target"), "rows", F.lit(len(df.columns)).alias("columns"), "files", "bytes", "content_hash",
            F.lit(name in sensitive).alias("sensitive"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def published_manifest(manifest: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Manifest rows with their description, source and sensitivity flags."""
    return lookup(manifest, descriptions, "target").orderBy("target")
