"""Scans with declared schemas and the configuration dimensions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annolytics.operators.annotate import RATER_SCHEMA
from annolytics.operators.reshape import rename_snake

CHART_SCHEMA = (
    "date date, song string, artist string, rank int, last_week int, peak_position int, weeks_in_charts string, "
    "image_url string"
)
PRICE_SCHEMA = (
    "model string, input_per_m double, output_per_m double, cached_input_per_m double, batch_discount_factor double, "
    "cache_discounts_with_batch boolean"
)
RATER_FIELDS = ("api", "model", "chat_function", "params", "processing", "prompt_batch_size")
MODES = ("sequential", "parallel", "batch")
# The chat functions whose service takes batch jobs.
BATCH_FUNCTIONS = ("chat_anthropic", "chat_openai", "chat_claude", "chat_groq_developer")

# List prices in dollars per million tokens.
LIST_PRICES = [
    ("openai/gpt-oss-20b", 0.075, 0.30, 0.037, 0.5, False),
    ("openai/gpt-oss-120b", 0.15, 0.60, 0.075, 0.5, False),
    ("moonshotai/kimi-k2-instruct-0905", 1.00, 3.00, 0.50, 0.5, False),
    ("meta-llama/llama-4-scout-17b-16e-instruct", 0.11, 0.34, None, 0.5, False),
    ("gemini-3-flash-preview", 0.50, 3.00, 0.05, 0.5, None),
]


def read_csv(
    spark: SparkSession, path: str, schema: str | StructType | None = None, line_breaks_in_fields: bool = False
) -> DataFrame:
    """CSV with a header; names normalised. Without a schema the types are inferred (small files only).

    Line breaks inside quoted fields make a file one unsplittable task; ask for them only where they occur.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks_in_fields).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return rename_snake(reader.csv(path))


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """Chart weeks, with ``-`` weeks as null numbers and ``#`` links as null."""
    chart = read_csv(spark, path, CHART_SCHEMA)
    return chart.withColumn("weeks_in_charts", F.nullif("weeks_in_charts", F.lit("-")).try_cast("int")).withColumn(
        "image_url", F.nullif("image_url", F.lit("#"))
    )


def reference_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct non-null entries of a one-column list."""
    return read_csv(spark, path).select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()


def coded_rows(df: DataFrame, coders: Sequence[str], coder: str = "coder_name") -> DataFrame:
    return df.where(F.col(coder).isin(list(coders)))


DEFAULTS = {"chat_function": None, "processing": "sequential", "prompt_batch_size": 5, "enabled": True}


def _settings(levels: Sequence[Mapping]) -> dict:
    """Settings of several levels, the last level that has one winning; parameters are merged one by one."""
    merged: dict = {"params": {}}
    for level in levels:
        given = {k: v for k, v in level.items() if v is not None}
        params = merged["params"] | {k: str(v) for k, v in (given.get("params") or {}).items()}
        merged |= given | {"params": params}
    return merged


def _fault(rater: Mapping) -> str | None:
    size = rater["prompt_batch_size"]
    checks = {
        f"unknown processing {rater['processing']!r}": rater["processing"] not in MODES,
        f"{rater['chat_function']} has no batch service": rater["processing"] == "batch" and rater["chat_function"] not in BATCH_FUNCTIONS,
        f"batches of {size!r} prompts": isinstance(size, (bool, str)) or not isinstance(size, (int, float)) or size < 1,
    }
    return next((text for text, wrong in checks.items() if wrong), None)


def raters_from_config(config: Mapping | str) -> list[dict]:
    """One record per enabled rater of a configuration, given as a mapping or JSON text.

    Settings come in three levels: defaults, the service, the rater. A bare string entry names a rater that has none of its
    own; raters without a name are left out.
    """
    services = json.loads(config) if isinstance(config, str) else config
    if not services:
        raise ValueError("the configuration names no service")
    found = []
    for api, service in services.items():
        shared = {k: v for k, v in service.items() if k not in ("models", "enabled")}
        for entry in service.get("models") or ():
            own = dict(entry) if isinstance(entry, Mapping) else {"name": entry}
            rater = _settings([DEFAULTS, shared, own]) | {"api": api, "model": own.get("name") or own.get("model")}
            if not (rater["model"] and rater["enabled"]):
                continue
            if fault := _fault(rater):
                raise ValueError(f"{api}/{rater['model']}: {fault}")
            found.append({field: rater[field] for field in RATER_FIELDS} | {"prompt_batch_size": int(rater["prompt_batch_size"])})
    return found


def rater_dimension(spark: SparkSession, config: Mapping | str) -> DataFrame:
    rows = [tuple(r.values()) for r in raters_from_config(config)]
    return spark.createDataFrame(rows, RATER_SCHEMA)


def price_dimension(spark: SparkSession, prices: Sequence[tuple] = LIST_PRICES) -> DataFrame:
    return spark.createDataFrame(list(prices), PRICE_SCHEMA)
