"""Importance resampling: the models by hand, the exact top k, held-out accuracy."""

import numpy as np
import pytest
from annolytics.llm import resample
from annolytics.llm.queries import QUERIES
from conftest import SMALL
from pyspark.sql import functions as F

GOOD, BAD = "the quiet river ran on to the sea and", "BUY!! NOW!! %%% CHEAP!! %%%"


def corpus(spark, n=60):
    rows = [(i, f"{BAD if i % 3 == 0 else GOOD} number {i}") for i in range(n)]
    labels = [(i, 0 if i % 3 == 0 else 1) for i in range(0, n, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_counts_and_ratios_by_hand(spark):
    docs, _ = corpus(spark, 9)
    raw, target = resample.ngram_counts(docs.repartition(3), [1, 2], 64)
    features = resample.Features(64)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = [np.bincount(np.concatenate([features.of(texts[i]) for i in ids]), minlength=64) for ids in (range(9), (1, 2))]
    assert (raw == want[0]).all() and (target == want[1]).all()
    ratios = resample.log_ratios(raw, target)
    assert ratios[features.of("BUY")[0]] < ratios[features.of("river")[0]]
    assert resample.log_ratios(np.zeros(4), np.zeros(4)) == pytest.approx(np.zeros(4))


def test_bad_documents_go(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in resample.select_good(docs, labels).collect()}
    assert kept == {i for i in range(60) if i % 3}
    judged = resample.resample(docs, labels).collect()
    assert {r.doc_id for r in judged if r.kept} == kept and len(judged) == 60


@pytest.mark.parametrize("k", [1, 2, 17, 99, 100])
def test_exact_rank_with_ties(spark, k):
    rng = np.random.default_rng(k)
    rows = [(float(v), int(i) if i % 9 else None, int(i)) for i, v in enumerate(np.round(rng.normal(size=100), 1))]
    df = spark.createDataFrame(rows, "v double, doc_id long, _th long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert resample.kth_largest(df, "v", k) == order[k - 1]


def test_threshold():
    assert resample.threshold(np.array([1.0, 2, 3, 9]), np.array([False, False, True, True])) == 2.5
    assert resample.threshold(np.array([1.0]), np.array([True])) == -np.inf


def test_defined_cases(spark):
    docs, labels = corpus(spark)
    more = docs.unionByName(spark.createDataFrame([(None, f"{GOOD} number 7"), (None, f"{GOOD} number 7"), (90, None), (91, " "), (92, f"{GOOD} number 7 " * 9)], docs.schema))
    more = more.selectExpr("*", "1 as _weight_", "2 as quality", "'x' as kept")
    out = resample.select_good(more, labels)
    assert out.columns == more.columns and {r.doc_id for r in out.collect()} >= {None, 92}
    assert resample.select_good(more, labels.limit(0)).count() == more.count()  # nothing can be judged
    assert resample.select_good(more.limit(0), labels).count() == 0 == resample.resample(more.limit(0), labels).count()
    nulls = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0)], labels.schema)
    assert resample.resample(docs, nulls).where("kept").count() == 60


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    judged = resample.resample(docs, labels.where(part)).join(labels.where(~part), "doc_id").collect()
    good = [r.kept for r in judged if r.quality]
    bad = [not r.kept for r in judged if not r.quality]
    assert np.mean(good) > 0.95 and np.mean(bad) > 0.9


def test_whole_query_against_a_plain_version(spark):
    """Models, threshold, variates and the k largest keys, worked out row by row."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    sample = resample.labelled_sample(labels, "doc_id", "quality", resample.LABELS)
    features, texts = resample.Features(), {r.doc_id: r.text or "" for r in docs.collect()}
    found = {i: features.of(t) for i, t in texts.items()}
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    chosen = {i for n, (i, good) in enumerate(sample) if good and n % 2 == 0}
    for i, f in found.items():
        for bucket in f:
            raw[bucket] += 1
            target[bucket] += i in chosen
    ratios = resample.log_ratios(raw, target)
    weights = {i: ratios[f].sum() / (len(f) + resample.SHRINK) * resample.LENGTH for i, f in found.items() if len(f)}
    judged = dict(sample[1::2])
    rows = [(weights[i], good == 1) for i, good in judged.items() if i in weights]
    cut = resample.threshold(np.array([w for w, _ in rows]), np.array([g for _, g in rows]))
    k = sum(w >= cut for w in weights.values())
    draws = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th")).withColumn("g", resample.gumbel(5, "doc_id", "_th"))
    keys = {r.doc_id: weights[r.doc_id] / resample.TEMPERATURE + r.g for r in draws.collect() if r.doc_id in weights}
    want = set(sorted(keys, key=lambda i: -keys[i])[:k])
    rows = QUERIES["op5_importance_resampling"](spark, SMALL).collect()
    assert {r.doc_id for r in rows if r.kept} == want and len(want) == k
    assert {r.doc_id: r.sample_key for r in rows if r.sample_key is not None} == {i: pytest.approx(x) for i, x in keys.items()}


def test_the_draw_is_by_weight():
    """Of two equal groups whose log weights differ by d, the draw takes as many as e^(d/T) to 1 says, at the start."""
    rng = np.random.default_rng(0)
    d, share = 1.0, []
    for _ in range(300):
        keys = np.repeat([d, 0.0], 200) / resample.TEMPERATURE + rng.gumbel(size=400)
        share.append((np.argsort(-keys)[:10] < 200).mean())
    odds = np.exp(d / resample.TEMPERATURE)
    assert np.mean(share) == pytest.approx(odds / (1 + odds), abs=0.03)


def test_query(spark):
    rows = QUERIES["op5_importance_resampling"](spark, SMALL).collect()
    assert len(rows) == 200 and 100 < sum(r.kept for r in rows) < 200


def test_names_that_clash(spark):
    docs, labels = corpus(spark)
    names = ["_th", "_n", "_weight", "_key", "_row", "_hash"]
    df = docs.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    kept = resample.select_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3}
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}
