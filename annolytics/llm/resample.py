"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and runs of marks, and pairs of neighbours, are hashed to ``BUCKETS`` buckets. The raw model counts them over
every document, the target model over the target documents. A document's log weight is the log ratio of its probabilities
under target and raw model, brought to a text of ``LENGTH`` n-grams so that long and short texts compare: the mean log
ratio of its n-grams, ``SHRINK`` neutral ones added, times ``LENGTH``. Its key is the log weight over ``temperature`` plus a
keyed standard Gumbel variate, and the k largest keys are kept: a draw of k documents without replacement, by weights to
the power of 1 over the temperature.

The target documents are labelled rows of good quality; at most ``LABELS`` labelled rows are used, the first by a hash
of their id (a documented bound, the same at any size of the corpus). k follows from the same rows: a threshold on the
log weight parts good from bad labelled rows best, and k is the number of documents above it. So the selection takes what
looks like the target, however much of that there is, and the draw decides about documents within a few units of the
threshold. One half of the labelled rows gives the target texts, the other half the threshold.

Defined cases: null and wordless texts have no weight (null) and are not kept where a threshold exists; repeated rows
share weight and variate and are kept or left out together; equal keys stand by id (null last) and text hash; without
usable labels nothing can be judged, and every document is kept; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from annolytics.llm.common import column_of, first_by_hash, slices, spread_out, text_or_empty, texts_of
from annolytics.session import discard, materialize

BUCKETS = 1 << 15
LABELS = 20_000
TEMPERATURE = 1.0
SMOOTHING = 1.0
#: N-grams that the weight of a document speaks of.
LENGTH = 100
#: N-grams of ratio 1 that every document is thought to hold besides its own: little text is little evidence.
SHRINK = 25
#: How many times as bad as keeping a bad document the loss of a good one is.
KEEP = 5
KNOWN_WORDS = 400_000
UNIT = re.compile(r"\w+|[^\w\s]+")
ODD = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Bucket numbers of the n-grams of texts. Case counts: a word in capitals is another unit."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = np.uint64(buckets), {}

    def of(self, text: str) -> np.ndarray:
        units = UNIT.findall(text)
        if not units:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        h = np.array([known.get(u) or known.setdefault(u, xxh64_intdigest(u) >> 1 | 1) for u in units], np.uint64)
        pairs = (h[:-1] * ODD + h[1:]) * ODD
        return (np.concatenate((h, pairs ^ pairs >> np.uint64(31))) % self.buckets).astype(np.int64)


def ngram_counts(texts: DataFrame, target_ids: list, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over all texts and over the texts of ``target_ids`` (a bounded list).

    Each task sums its texts and gives one row for each bucket it met, so what moves grows with the tasks, not the texts.
    """
    chosen = texts.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, target = Features(buckets), chosen.value
        sums = np.zeros((2, buckets), np.int64)
        for batch in slices(batches):
            found = [(i, features.of(t)) for i, t in zip(column_of(batch, "doc_id"), texts_of(batch, "text"), strict=True)]
            for row, part in enumerate((found, [x for x in found if x[0] in target])):
                if part:
                    sums[row] += np.bincount(np.concatenate([f for _, f in part]), minlength=buckets)
        met = np.nonzero(sums[0])[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(sums[0][met]), pa.array(sums[1][met])], names=["bucket", "raw", "target"]
        )

    parts = spread_out(texts).mapInArrow(run, "bucket long, raw long, target long")
    total = np.zeros((2, buckets))
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toLocalIterator():
        total[:, r.bucket] = r.raw, r.target  # one row a bucket
    return total[0], total[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of every bucket; rare buckets lean to 0."""
    mass = SMOOTHING * len(raw)
    prior = (raw + SMOOTHING) / (raw.sum() + mass)
    own = (target + mass * prior) / (target.sum() + mass)
    return np.log(own / prior)


def with_weights(df: DataFrame, ratios: np.ndarray, text_column: str, row: str | None = None) -> DataFrame:
    """``df`` with ``_n`` (n-grams), ``_weight`` (log weight; null without n-grams) and ``_th`` (hash of the text).

    The text is a column of ``df``, or a field of its struct ``row``.
    """
    sent = df.sparkSession.sparkContext.broadcast(ratios)
    text = F.col(row)[text_column] if row else F.col(text_column)
    wanted = df.withColumn("_th", F.xxhash64(F.coalesce(text, F.lit(""))))
    out = wanted.withColumns({"_n": F.lit(0).cast("long"), "_weight": F.lit(None).cast("double")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ratio = Features(len(sent.value)), sent.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(row).field(text_column).to_pylist()] if row else texts_of(batch, text_column)
            found = [features.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(map(len, found), pa.int64()),
                 pa.array([float(ratio[f].sum() * LENGTH / (len(f) + SHRINK)) if len(f) else None for f in found], pa.float64())], names=out.names,
            )

    return spread_out(wanted).mapInArrow(run, out)


def threshold(values: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best sum of both recalls, that of good rows ``KEEP`` times: of equals in the widest gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    recall = KEEP - KEEP * np.concatenate(([0], np.cumsum(g))) / g.sum() + np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    edges = np.concatenate(([v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]))
    gaps = np.concatenate(([0], np.diff(v), [0]))
    allowed = np.concatenate(([True], v[1:] > v[:-1], [True]))
    best = allowed & (recall >= recall[allowed].max() - 1e-12)
    return float(edges[np.nonzero(best)[0][np.argmax(gaps[best])]])


def labelled_sample(labels: DataFrame, id_column: str, label_column: str, most: int) -> list[tuple]:
    """At most ``most`` labelled rows ``(id, good)``, by a hash of the id; rows of one id that disagree are dropped."""
    rows = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(
        F.col(id_column).alias("doc_id")
    ).agg(F.min(label_column).alias("low"), F.max(label_column).alias("high")).where("low = high")
    return [(r.doc_id, r.low > 0) for r in first_by_hash(rows, F.xxhash64("doc_id"), most, "doc_id").collect()]


def gumbel(seed: int, *columns: str) -> Column:
    """A keyed standard Gumbel variate."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(F.col, columns)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def perturbed(id_column: str, seed: int, temperature: float) -> Column:
    """The key by which documents are drawn."""
    return F.col("_weight") / F.lit(float(temperature)) + gumbel(seed, id_column, "_th")


def fitted(
    df: DataFrame, labels: DataFrame, id_column: str, text_column: str, *, label_column: str = "quality",
    buckets: int = BUCKETS, most_labels: int = LABELS, temperature: float = TEMPERATURE, seed: int = 0,
) -> tuple[np.ndarray, DataFrame, Column]:
    """Log ratios of the buckets, the stored ``doc_id, _th, _n, _weight, _key`` and the test for what is kept."""
    texts = df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    sample = labelled_sample(labels, id_column, label_column, most_labels)
    # one half gives the target texts, the other the threshold: a text is more likely under counts that hold itself
    raw, target = ngram_counts(texts, [i for n, (i, good) in enumerate(sample) if good and n % 2 == 0], buckets)
    ratios = log_ratios(raw, target)
    scored = materialize(
        with_weights(texts, ratios, "text").drop("text").withColumn("_key", perturbed("doc_id", seed, temperature)), "weights"
    )
    judged = dict(sample[1::2])
    found = []
    if judged:  # bounded by most_labels, up to repeated rows, of which one a text is enough
        chosen = df.sparkSession.createDataFrame([(i,) for i in judged], scored.select("doc_id").schema)
        found = scored.join(F.broadcast(chosen), "doc_id", "left_semi").where("_weight is not null").groupBy("doc_id").agg(
            F.min("_weight").alias("w")
        ).collect()
    cut = threshold(np.array([r.w for r in found]), np.array([judged[r.doc_id] for r in found], bool)) if found else -np.inf
    if not np.isfinite(cut):
        return ratios, scored, F.lit(True)
    k = scored.where(F.col("_weight") >= cut).count()
    return ratios, scored, _above(kth_largest(scored, "_key", k), id_column)


def resample(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """For every row its number of n-grams, weight, perturbed weight and whether it is among the k kept."""
    _, scored, kept = fitted(df, labels, id_column, text_column, **options)
    return scored.withColumnRenamed("doc_id", id_column).select(
        F.col(id_column), F.col("_n").alias("n_ngrams"), F.col("_weight").alias("log_weight"), F.col("_key").alias("sample_key"),
        kept.alias("kept"),
    )


def select_good(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, temperature: float = TEMPERATURE,
    seed: int = 0, **options,
) -> DataFrame:
    """The rows of ``df`` that :func:`resample` keeps. The texts stay where they are: each is judged again in place."""
    ratios, scored, kept = fitted(df, labels, id_column, text_column, temperature=temperature, seed=seed, **options)
    discard(scored)
    # the caller's columns travel as one, so that none of them can clash
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(id_column).alias(id_column))
    judged = with_weights(rows, ratios, text_column, "_row").withColumn("_key", perturbed(id_column, seed, temperature))
    return judged.where(kept).select("_row.*")


def _above(last: tuple | None, id_column: str) -> Column:
    """Whether a row stands at rank k or before it, given the row at rank k."""
    if last is None:
        return F.lit(False)
    key, doc, th = last
    before = F.col(id_column).isNotNull() if doc is None else F.coalesce(F.col(id_column) < doc, F.lit(False))
    tie = before | (F.col(id_column).eqNullSafe(F.lit(doc)) & (F.col("_th") <= th))
    return F.coalesce((F.col("_key") > key) | (F.col("_key") == key) & tie, F.lit(False))


def kth_largest(df: DataFrame, column: str, k: int) -> tuple | None:
    """``(value, doc_id, _th)`` of the row at rank k by descending value, then id (nulls last), then text hash.

    The value is narrowed by counting passes over a histogram of the current range; only the rows that share the last
    bin are sorted, of which at most the needed number is fetched.
    """
    if k < 1:
        return None
    rows = df.where(F.col(column).isNotNull())
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        raise ValueError(f"{k} of {n} rows")
    left, bins = k, 4096
    while True:
        width = (high - low) / bins
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        if not width or not np.isfinite(width) or low + width == low:
            break
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(bin_of.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).orderBy(F.desc("b")).collect()
        for b in found:  # at most one row a bin
            if left <= b.n:
                break
            left -= b.n
        narrower = (b.low, b.high)
        if narrower == (low, high) and len(found) == 1:
            break
        low, high = narrower
        if b.n <= 10_000:
            inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
            break
    order = [F.desc(column), F.col("doc_id").asc_nulls_last(), F.col("_th")]
    row = inside.orderBy(*order).select(column, "doc_id", "_th").offset(left - 1).limit(1).first()
    return row[0], row[1], row[2]
