"""A training corpus from raw documents: quality, near copies, personal data, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes to the shared folder and
reads again as the next stage's ``docs``. All but the last return the columns of ``documents``. Null ids, null and
empty texts, repeated rows and empty tables pass as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolytics.llm import merge_dropout, mixing, ngram_join, pii, resample
from annolytics.llm.queries import WEIGHTS, table
from annolytics.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards labelled good documents: what it rejects goes."""
    return resample.select_good(docs, table(spark, sf_dir, "labels"), seed=5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs, length_column="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target weights: interleaved in order, small sources read again where their weight asks for it."""
    return mixing.mix(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with seeded merge-dropout, and its place in the mixture.

    ``slot`` and ``within`` hold the order of the mixture, which a table of several files does not keep by itself.
    """
    placed = materialize(mixing.places(docs, WEIGHTS), "placed")
    return merge_dropout.encode(placed, seed=20, keep=["source", "slot", "within"])


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("PII", personal_data),
    ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", tokens),
]

#: Trained models and seeded hashes decide in four stages, which SQL cannot express: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
