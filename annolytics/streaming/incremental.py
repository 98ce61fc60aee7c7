"""Incremental rollup and annotation with Structured Streaming.

State is a table of partial results, one folder per micro-batch. A replayed batch overwrites its own folder, so the
merge is idempotent, and the cost of a batch depends on its own size and not on the state's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.operators import annotate
from annolytics.operators.aggregate import entity_rollup, year_at_best
from annolytics.sources.files import list_batches, list_folders


def merge_rollups(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial rollups: weeks add up, the best rank is the minimum, the year is the latest at that rank."""
    year = year_at_best(F.col("top"), F.col("year")).alias("year")
    return parts.groupBy(*keys).agg(F.sum("weeks").alias("weeks"), F.min("top").alias("top"), year)


def read_rollup(spark: SparkSession, state: str, keys: Sequence[str]) -> DataFrame:
    return merge_rollups(spark.read.parquet(f"{state}/parts").drop("batch"), keys)


def stream_rollup(source: DataFrame, state: str, keys: Sequence[str], rank: str, date: str) -> None:
    """Consume what a streaming source offers now and add its partial rollup to ``state``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        partial = entity_rollup(batch, keys, rank, date)
        partial.write.mode("overwrite").parquet(f"{state}/parts/batch={batch_id}")

    query = (
        source.writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def compact_rollup(spark: SparkSession, state: str, target: str, keys: Sequence[str]) -> None:
    """Fold all parts of ``state`` into one part of a new state folder ``target``."""
    read_rollup(spark, state, keys).write.mode("overwrite").parquet(f"{target}/parts/batch=-1")


PREFIX_DIGITS = 2  # 256 folders of results; more digits for a longer history


def earlier_answers(spark: SparkSession, results: str, prefixes: Sequence[str], batch_id: int) -> DataFrame | None:
    """Stored ``prompt_digest, model`` pairs of the given digest prefixes from other micro-batches; no other folder is read."""
    stored = set(list_folders(spark, f"{results}/parts"))
    found = [
        path for prefix in sorted(prefixes) if f"prefix={prefix}" in stored
        for number, path in list_batches(spark, f"{results}/parts/prefix={prefix}", finished_only=False) if number != batch_id
    ]
    return spark.read.schema(annotate.RESPONSE_SCHEMA).parquet(*found).select("prompt_digest", "model") if found else None


def read_annotations(spark: SparkSession, results: str) -> DataFrame:
    rows = spark.read.schema(annotate.RESPONSE_SCHEMA).parquet(f"{results}/parts")
    return rows.select(*[f.split()[0] for f in annotate.RESPONSE_SCHEMA.split(", ")])


def stream_annotation(
    source: DataFrame, results: str, raters: Sequence[Mapping], scorer: annotate.Scorer, digits: int = PREFIX_DIGITS
) -> None:
    """Score prompts (``prompt_digest, prompt``) as they arrive, once per digest and model.

    Answers are stored by the first ``digits`` of the digest and by micro-batch. A micro-batch reads the prefixes of its own
    digests only, so for each new prompt a share of 16 to the minus ``digits`` of the history at most, and is cut into
    batches of each rater's own size.
    """
    prefix = F.left("prompt_digest", F.lit(digits))

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.where("prompt_digest is not null").select(prefix).distinct().collect()]  # 16^digits at most
        done = earlier_answers(spark, results, touched, batch_id)
        answers = annotate.score(batch, raters, scorer, done).withColumn("prefix", prefix).withColumn("batch", F.lit(batch_id))
        answers.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "prefix", "batch"
        ).parquet(f"{results}/parts")

    query = (
        source.writeStream.foreachBatch(add).option("checkpointLocation", f"{results}/offsets")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
