"""Table sinks: paired columnar and CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested types: those columns are written as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV with a header, null as an empty field. ``single_file`` is for small results only."""
    out = _flat(df)
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').option(
        "escape", '"'
    ).csv(path)
    return path


def write_pair(df: DataFrame, stem: str) -> dict[str, str]:
    """The same table as Parquet and as CSV. Parquet is written first and the CSV is made from it."""
    df.write.mode("overwrite").parquet(f"{stem}.parquet")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{stem}.parquet")
    return {"parquet": f"{stem}.parquet", "csv": write_csv(stored, f"{stem}.csv")}
