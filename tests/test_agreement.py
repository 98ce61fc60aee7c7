"""Agreement coefficients against plain Python on small panels."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from annolytics.operators import agreement
from pyspark.sql import functions as F


def panel(seed=3, items=60, raters=4, missing=0.2, labels=("x", "y", "z")):
    rng = random.Random(seed)
    rows = []
    for i in range(items):
        truth = rng.choice(labels)
        for r in range(raters):
            if rng.random() < missing:
                value = None
            else:
                value = truth if rng.random() < 0.7 else rng.choice(labels)
            rows.append((i, f"r{r}", value))
    rows += [(items, f"r{r}", None) for r in range(raters)]  # nobody rated it
    rows += [(items + 1, "r0", labels[0])]  # only one rating
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "item int, rater string, value string")


def matrix(rows, labels):
    items = sorted({r[0] for r in rows})
    return [[sum(1 for i, _, v in rows if i == item and v == q) for q in labels] for item in items]


LABELS = ["x", "y", "z"]


def brute_fleiss(rows, labels):
    n = np.array([c for c in matrix(rows, labels) if sum(c) > 0], dtype=float)
    r = n.sum(1)
    two = r >= 2
    pa_i = np.where(two, (n * (n - 1)).sum(1) / np.maximum(r * (r - 1), 1), 0)
    pa, pi = pa_i[two].mean(), (n / r[:, None]).mean(0)
    pe = (pi**2).sum()
    kappa = (pa - pe) / (1 - pe)
    k_i = np.where(two, len(n) / two.sum() * (pa_i - pe) / (1 - pe), 0)
    star = k_i - 2 * (1 - kappa) * ((n / r[:, None]) @ pi - pe) / (1 - pe)
    return kappa, math.sqrt(((star - kappa) ** 2).sum() / (len(n) * (len(n) - 1)))


def brute_alpha(rows, labels):
    n = np.array([c for c in matrix(rows, labels) if sum(c) >= 2], dtype=float)
    m = n.sum(1)
    do = ((m**2 - (n**2).sum(1)) / (m - 1)).sum() / m.sum()
    c = n.sum(0)
    de = (c.sum() ** 2 - (c**2).sum()) / (c.sum() * (c.sum() - 1))
    return 1 - do / de


def test_fleiss_and_alpha_with_missing_ratings(spark):
    rows = panel()
    got = agreement.fleiss_available(frame(spark, rows), ["item"], "value", LABELS).first()
    kappa, se = brute_fleiss(rows, LABELS)
    assert got.kappa == pytest.approx(kappa, abs=1e-12) and got.se == pytest.approx(se, abs=1e-10)
    assert got.low < got.kappa < got.high <= 1
    assert agreement.krippendorff(frame(spark, rows), ["item"], "value", LABELS).first().alpha == pytest.approx(brute_alpha(rows, LABELS))


def brute_alpha_se(rows, labels):
    """Item by item, as the linearised coefficient is defined."""
    n = np.array([c for c in matrix(rows, labels) if sum(c) >= 2], dtype=float)
    m = n.sum(1)
    r = m.mean()
    pi = (n / r).mean(0)
    pe = (pi**2).sum()
    each = (n * (n - 1)).sum(1) / (r * (m - 1))
    whole = each.mean()
    prime = (whole - pe) / (1 - pe)
    star = (each - whole * (m - r) / r - pe) / (1 - pe)
    star = star - 2 * (1 - prime) * ((n @ pi) / r - pe * (m - r) / r - pe) / (1 - pe)
    return math.sqrt(((star - prime) ** 2).sum() / (len(n) * (len(n) - 1)))


def test_interval_of_alpha(spark):
    rows = panel(11)
    got = agreement.krippendorff(frame(spark, rows), ["item"], "value", LABELS).first()
    assert got.se == pytest.approx(brute_alpha_se(rows, LABELS), abs=1e-10)
    assert got.low < got.alpha < got.high <= 1 and got.high - got.alpha == pytest.approx(got.alpha - got.low)


def test_correlations_of_five_hundred_raters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 500)) + rng.normal(size=(40, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"r{j}" for j in range(500)]
    table = pd.DataFrame([(i, names[j], float(x[i, j])) for i in range(40) for j in range(500) if not np.isnan(x[i, j])], columns=["item", "rater", "value"])
    got = agreement.correlations(spark.createDataFrame(table), ["item"], "rater", "value", names).toPandas()
    assert len(got) == 500 * 499 / 2
    for a, b, n, r in got.sample(40, random_state=1).itertuples(index=False):
        u, v = x[:, names.index(a)], x[:, names.index(b)]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert n == both.sum() and r == pytest.approx(np.corrcoef(u[both], v[both])[0, 1])
        assert names.index(a) < names.index(b)


def test_coefficients_ignore_rater_names(spark):
    rows = panel(5)
    renamed = [(i, {"r0": "r3", "r3": "r0"}.get(r, r), v) for i, r, v in rows]
    a, b = (agreement.fleiss_available(frame(spark, x), ["item"], "value", LABELS).first().kappa for x in (rows, renamed))
    assert a == pytest.approx(b)


def test_fleiss_complete_uses_complete_items_only(spark):
    rows = panel(7)
    full = {i for i in {r[0] for r in rows} if sum(1 for a, _, v in rows if a == i and v is not None) == 4}
    got = agreement.fleiss_complete(frame(spark, rows), ["item"], "value", LABELS, 4).first()
    n = np.array(matrix([r for r in rows if r[0] in full], LABELS), dtype=float)
    po, p = ((n**2).sum(1) - 4).mean() / 12, n.sum(0) / n.sum()
    assert got.items == len(full) and got.kappa == pytest.approx((po - (p**2).sum()) / (1 - (p**2).sum()))


def test_perfect_and_constant_raters(spark):
    perfect = [(i, r, "x" if i % 2 else "y") for i in range(6) for r in ("a", "b", "c")]
    assert agreement.fleiss_available(frame(spark, perfect), ["item"], "value", LABELS).first().kappa == pytest.approx(1)
    constant = [(i, r, "x") for i in range(4) for r in ("a", "b")]
    assert agreement.fleiss_available(frame(spark, constant), ["item"], "value", LABELS).first().kappa is None
    assert agreement.krippendorff(frame(spark, constant), ["item"], "value", LABELS).first().alpha is None
    pairs = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert agreement.cohen_kappa(pairs, "a", "b").first().kappa is None


def test_cohen_two_by_two(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")] * 4
    got = agreement.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    pe = 0.5 * 0.6 + 0.5 * 0.4
    third = 0.5 * 0.6 * 1.1 + 0.5 * 0.4 * 0.9
    z = 0.4 / math.sqrt((pe + pe * pe - third) / (50 * (1 - pe) ** 2))
    assert (got.n, got.agreement, got.kappa) == (50, pytest.approx(0.7), pytest.approx(0.4))
    assert got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_correlations_are_pairwise_complete(spark):
    rng = random.Random(2)
    rows = [(i, f"r{r}", None if rng.random() < 0.3 else round(rng.random(), 1)) for i in range(200) for r in range(4)]
    df = spark.createDataFrame(rows, "item int, rater string, value double")
    got = {(r.rater_a, r.rater_b): (r.n, r.r) for r in agreement.correlations(df, ["item"], "rater", "value", ["r0", "r1", "r2", "r3"]).collect()}
    value = {(i, r): v for i, r, v in rows}
    for a, b in combinations(["r0", "r1", "r2", "r3"], 2):
        both = [(value[i, a], value[i, b]) for i in range(200) if value[i, a] is not None and value[i, b] is not None]
        assert got[a, b] == (len(both), pytest.approx(np.corrcoef(np.array(both).T)[0, 1]))


def test_constant_rater_has_no_correlation(spark):
    df = spark.createDataFrame([(i, r, 1.0 if r == "a" else float(i)) for i in range(5) for r in "ab"], "item int, rater string, value double")
    assert agreement.correlations(df, ["item"], "rater", "value", ["a", "b"]).first().r is None


def test_consensus(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False), (2, False), (3, True), (3, False), (4, True), (4, None)], "item int, v boolean")
    assert {r.item: r.consensus for r in agreement.consensus(df, "item", "v", 2).collect()} == {1: "yes", 2: "no", 3: "disagree", 4: "disagree"}


def test_grouped_equals_separate(spark):
    both = frame(spark, panel(1)).withColumn("g", F.lit(1)).unionByName(frame(spark, panel(2)).withColumn("g", F.lit(2)))
    got = {r.g: r.kappa for r in agreement.fleiss_available(both, ["item"], "value", LABELS, ["g"]).collect()}
    assert got == {g: pytest.approx(brute_fleiss(panel(g), LABELS)[0]) for g in (1, 2)}
