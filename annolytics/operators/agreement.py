"""Agreement between raters, all from long (item, rater, value) tables without a self-join.

Ratings are first turned into label counts per item (one shuffle on the item). Every coefficient is then a closed form
over sums of those counts, so a second aggregate down to one row per group finishes it. Pair statistics are cross
products of the raters' values that tasks sum as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions import stats


def _sum_of(columns: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def label_counts(ratings: DataFrame, item: Sequence[str], value: str, labels: Sequence) -> tuple[DataFrame, list[str]]:
    """One row per item with the number of ratings of each label; labels are a short, known list."""
    names = [f"_n{i}" for i in range(len(labels))]
    cells = [F.count_if(F.col(value) == F.lit(q)).cast("double").alias(n) for q, n in zip(labels, names, strict=True)]
    return ratings.groupBy(*item).agg(*cells), names


def percent_agreement(ratings: DataFrame, item: str, rater: str, value: str, a: str, b: str) -> DataFrame:
    """Share of items on which two raters agree, over items both rated."""
    pair = ratings.where(F.col(rater).isin(a, b)).groupBy(item).agg(
        F.max(F.when(F.col(rater) == a, F.col(value))).alias("_a"),
        F.max(F.when(F.col(rater) == b, F.col(value))).alias("_b"),
    )
    same = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.col("_a") == F.col("_b")).cast("double"))
    return pair.agg(F.count(same).alias("n"), F.avg(same).alias("agreement"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa with the null-hypothesis z test (Fleiss, Cohen and Everitt 1969), per group.

    ``pairs`` holds one row per item with both labels; rows with a null label are left out. A group whose expected
    agreement is 1 gets null.
    """
    cells = (
        pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*by, a, b)
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    none = F.lit(0.0)
    sides = F.array(
        F.struct(F.col(a).alias("label"), F.col("_n").alias("r"), none.alias("c"),
                 F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(none).alias("d")),
        F.struct(F.col(b).alias("label"), none.alias("r"), F.col("_n").alias("c"), none.alias("d")),
    )
    margins = cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("d")
    )
    r, c = F.col("r"), F.col("c")
    sums = margins.groupBy(*by).agg(
        F.sum(r).alias("n"), F.sum("d").alias("d"), F.sum(r * c).alias("rc"), F.sum(r * c * (r + c)).alias("rcs")
    )
    n = F.col("n")
    po, pe, third = F.col("d") / n, F.col("rc") / (n * n), F.col("rcs") / (n * n * n)
    variance = F.try_divide(pe + pe * pe - third, n * (1 - pe) * (1 - pe))
    kappa = F.when(pe < 1, F.try_divide(po - pe, 1 - pe))
    z = F.try_divide(kappa, F.sqrt(variance))
    return sums.where(n > 0).select(
        *by, n.cast("long").alias("n"), po.alias("agreement"), kappa.alias("kappa"), z.alias("z"),
        stats.two_sided_p(z).alias("p"),
    )


def kappa_against(ratings: DataFrame, reference: DataFrame, item: str, rater: str, value: str, truth: str) -> DataFrame:
    """Cohen's kappa of every rater against a reference label per item, in one job for all raters."""
    joined = ratings.join(reference.where(F.col(truth).isNotNull()).select(item, truth), item)
    return cohen_kappa(joined, value, truth, [rater])


def consensus(ratings: DataFrame, item: str, value: str, raters: int) -> DataFrame:
    """``yes`` / ``no`` when all raters gave the same label, else ``disagree`` (a missing label disagrees)."""
    per_item = ratings.groupBy(item).agg(
        F.count(value).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    whole = (F.col("_n") == raters) & (F.col("_low") == F.col("_high"))
    label = F.when(whole & F.col("_low"), "yes").when(whole, "no").otherwise("disagree")
    return per_item.select(item, label.alias("consensus"))


def fleiss_complete(ratings: DataFrame, item: Sequence[str], value: str, labels: Sequence, raters: int) -> DataFrame:
    """Fleiss' kappa over items that every rater labelled."""
    counts, names = label_counts(ratings, item, value, labels)
    n_q = [F.col(c) for c in names]
    size = float(raters)
    whole = counts.where(_sum_of(n_q) == size)
    agree = F.try_divide(_sum_of([c * c for c in n_q]) - size, F.lit(size * (size - 1)))
    sums = whole.agg(F.count(F.lit(1)).alias("items"), F.avg(agree).alias("po"), *[F.sum(c).alias(c_) for c, c_ in zip(n_q, names, strict=True)])
    total = F.col("items") * size
    pe = _sum_of([F.pow(F.try_divide(c, total), F.lit(2.0)) for c in n_q])
    return sums.select("items", F.try_divide(F.col("po") - pe, 1 - pe).alias("kappa"))


def fleiss_available(
    ratings: DataFrame, item: Sequence[str], value: str, labels: Sequence, by: Sequence[str] = ()
) -> DataFrame:
    """Fleiss' kappa with missing ratings (Gwet 2014) and its 95 % interval, per group, in a single pass.

    The linearised variance needs sums of pa, s_q and their products only (s_q: the item's share of label q), so no
    second scan with the finished kappa is needed.
    """
    counts, names = label_counts(ratings, [*by, *item], value, labels)
    n_q = [F.col(c) for c in names]
    rated = counts.withColumn("_r", _sum_of(n_q)).where(F.col("_r") > 0)
    r = F.col("_r")
    pa = F.when(r >= 2, F.try_divide(_sum_of([c * (c - 1) for c in n_q]), r * (r - 1)))
    shares = rated.select(
        *by, pa.alias("_pa"), (r >= 2).cast("double").alias("_two"), *[(c / r).alias(f"s{i}") for i, c in enumerate(n_q)]
    )
    q = range(len(labels))
    two, p0 = F.col("_two"), F.coalesce("_pa", F.lit(0.0))
    sums = shares.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(two).alias("n2"), F.sum("_pa").alias("pa"),
        F.sum(p0 * p0).alias("pa2"),
        *[F.sum(f"s{i}").alias(f"s{i}") for i in q],
        *[F.sum(two * F.col(f"s{i}")).alias(f"t{i}") for i in q],
        *[F.sum(p0 * F.col(f"s{i}")).alias(f"ps{i}") for i in q],
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"ss{i}_{j}") for i in q for j in q if i <= j],
    )
    n, n2 = F.col("n"), F.col("n2")
    prior = [F.col(f"s{i}") / n for i in q]
    pe = _sum_of([p * p for p in prior])
    po = F.try_divide(F.col("pa"), n2)
    kappa = F.try_divide(po - pe, 1 - pe)
    base = sums.withColumn("_pe", pe).withColumn("_kappa", kappa)
    k, e = F.col("_kappa"), F.col("_pe")
    # kappa*_i = A (pa_i - pe) [r_i >= 2] - B (pe_i - pe), with pe_i = sum of prior_q * s_iq
    a = F.try_divide(F.try_divide(n, n2), 1 - e)
    b = F.try_divide(2 * (1 - k), 1 - e)
    sum_pe = _sum_of([p * F.col(f"s{i}") for i, p in enumerate(prior)])
    sum_pe_two = _sum_of([p * F.col(f"t{i}") for i, p in enumerate(prior)])
    sum_pa_pe = _sum_of([p * F.col(f"ps{i}") for i, p in enumerate(prior)])
    sum_pe2 = _sum_of(
        [prior[i] * prior[j] * F.col(f"ss{min(i, j)}_{max(i, j)}") for i in q for j in q]
    )
    first2 = a * a * (F.col("pa2") - 2 * e * F.col("pa") + e * e * n2)
    cross = a * b * (sum_pa_pe - e * F.col("pa") - e * sum_pe_two + e * e * n2)
    second2 = b * b * (sum_pe2 - 2 * e * sum_pe + e * e * n)
    squares = first2 - 2 * cross + second2
    mean_star = (a * (F.col("pa") - e * n2) - b * (sum_pe - e * n)) / n
    spread = squares - 2 * k * n * mean_star + n * k * k
    variance = F.try_divide(spread, n * (n - 1))
    se = F.sqrt(F.when(variance.isNotNull(), F.greatest(variance, F.lit(0.0))))
    half = F.when(n > 1, stats.t_975(n - 1)) * se
    return base.select(
        *by, n.cast("long").alias("items"), k.alias("kappa"), se.alias("se"),
        (k - half).alias("low"), F.when((k + half).isNotNull(), F.least(k + half, F.lit(1.0))).alias("high"),
    )


def krippendorff(ratings: DataFrame, item: Sequence[str], value: str, labels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Nominal alpha over items with two or more ratings and its 95 % interval, per group, in a single pass.

    With m ratings of an item, n_q of them label q, s = sum of n_q (n_q - 1) / (m - 1), r ratings an item on average and
    pi_q the share of label q, the linearised alpha of an item (Gwet 2014) departs from alpha by
    (s - k m - g sum of pi_q n_q) / (r (1 - pe)), where k and g follow from the whole; so the variance is a form in sums of
    products of s, m and n_q.
    """
    counts, names = label_counts(ratings, [*by, *item], value, labels)
    n_q = [F.col(c) for c in names]
    q = range(len(names))
    paired = counts.withColumn("_m", _sum_of(n_q).cast("double")).where(F.col("_m") >= 2)
    m = F.col("_m")
    paired = paired.withColumn("_s", _sum_of([c * (c - 1) for c in n_q]) / (m - 1))
    s = F.col("_s")
    sums = paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.sum(m).alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("s2"), F.sum(m * m).alias("m2"),
        F.sum(s * m).alias("sm"), *[F.sum(c.cast("double")).alias(f"t{i}") for i, c in enumerate(n_q)],
        *[F.sum(s * c).alias(f"st{i}") for i, c in enumerate(n_q)], *[F.sum(m * c).alias(f"mt{i}") for i, c in enumerate(n_q)],
        *[F.sum((n_q[i] * n_q[j]).cast("double")).alias(f"tt{i}_{j}") for i in q for j in q if i <= j],
    )
    n, items = F.col("n"), F.col("items").cast("double")
    observed = 1 - F.col("s") / n
    expected = F.try_divide(n * n - _sum_of([F.col(f"t{i}") * F.col(f"t{i}") for i in q]), n * (n - 1))
    pi = [F.col(f"t{i}") / n for i in q]
    base = sums.where(n > 0).withColumns({
        "_alpha": 1 - F.try_divide(observed, expected), "_pe": _sum_of([p * p for p in pi]), "_pa": F.col("s") / n,
    })
    alpha, pe, pa = F.col("_alpha"), F.col("_pe"), F.col("_pa")
    g = 2 * (1 - F.try_divide(pa - pe, 1 - pe))
    k = pa - g * pe
    c2 = _sum_of([pi[i] * pi[j] * F.col(f"tt{min(i, j)}_{max(i, j)}") for i in q for j in q])
    sc, mc = _sum_of([pi[i] * F.col(f"st{i}") for i in q]), _sum_of([pi[i] * F.col(f"mt{i}") for i in q])
    squares = F.col("s2") + k * k * F.col("m2") + g * g * c2 - 2 * k * F.col("sm") - 2 * g * sc + 2 * k * g * mc
    scale = n / items * (1 - pe)
    variance = F.try_divide(squares, scale * scale * items * (items - 1))
    se = F.sqrt(F.when(variance.isNotNull(), F.greatest(variance, F.lit(0.0))))
    half = F.when(items > 1, stats.t_975(items - 1)) * se
    return base.select(
        *by, "items", alpha.alias("alpha"), F.when(alpha.isNotNull(), se).alias("se"), (alpha - half).alias("low"),
        F.when((alpha + half).isNotNull(), F.least(alpha + half, F.lit(1.0))).alias("high"),
    )


def response_patterns(ratings: DataFrame, item: Sequence[str], rater: str, value: str, raters: Sequence[str]) -> DataFrame:
    """Distinct rows of the item-by-rater table with their number: columns ``r0``.. in rater order, and ``n``."""
    cells = [F.max(F.when(F.col(rater) == r, F.col(value).cast("double"))).alias(f"r{i}") for i, r in enumerate(raters)]
    rows = ratings.groupBy(*item).agg(*cells)
    return rows.groupBy(*[f"r{i}" for i in range(len(raters))]).agg(F.count(F.lit(1)).alias("n"))


def with_reasons(items: DataFrame, ratings: DataFrame, item: Sequence[str], rater: str, reason: str, raters: Sequence[str]) -> DataFrame:
    """A few items with the reasons of the given raters side by side, null where a rater gave none."""
    told = ratings.where(F.col(rater).isin(list(raters))).join(items.select(*item), list(item), "left_semi")
    cells = [F.max(F.when(F.col(rater) == r, F.col(reason))).alias(f"{reason}_{r}") for r in raters]
    return items.join(told.groupBy(*item).agg(*cells), list(item), "left")


def lone_voters(ratings: DataFrame, item: str, rater: str, value: str, reason: str, baseline: str) -> DataFrame:
    """Items with a single positive vote, all raters having voted: the voter's reason beside that of the baseline rater.

    Both rows are found in one grouping; items whose voter is the baseline rater itself, or that it did not rate, are left out.
    """
    yes, base = F.col(value), F.col(rater) == baseline
    found = ratings.groupBy(item).agg(
        F.sum(F.col(value).cast("int")).alias("_votes"), F.count(value).alias("_given"), F.count(F.lit(1)).alias("_all"),
        F.max(F.when(yes, F.col(rater))).alias("voter"), F.max(F.when(yes, F.col(reason))).alias("voter_reason"),
        F.max(F.when(base, F.col(reason))).alias("baseline_reason"),
    )
    lone = (F.col("_votes") == 1) & (F.col("_given") == F.col("_all")) & (F.col("voter") != baseline) & F.col("baseline_reason").isNotNull()
    return found.where(lone).select(item, "voter", "voter_reason", "baseline_reason")


PAIR_SUMS = ("w", "sx", "sy", "sxx", "syy", "sxy")


def _pair_sums(ratings: DataFrame, row: Sequence[str], rater: str, value: str, raters: Sequence[str], absent: float | None = None) -> DataFrame:
    """``rater_a, rater_b`` (in the order given) and sums over the rows that both rated, from long ratings.

    The values of a row are gathered, one for each rater at most; a task multiplies its rows as matrices and sends the
    sums of all pairs once, however many raters there are. ``absent`` stands for missing values; without it they drop out.
    """
    raters = list(raters)
    place = F.map_from_arrays(F.array(*map(F.lit, raters)), F.array(*map(F.lit, range(len(raters)))))[F.col(rater)]
    numbered = ratings.where(F.col(rater).isin(raters)).select(*row, place.cast("int").alias("_at"), F.col(value).cast("double").alias("_v"))
    once = numbered.where(F.col("_v").isNotNull()).groupBy(*row, "_at").agg(F.max("_v").alias("_v"))
    rows = once.groupBy(*row).agg(F.collect_list("_at").alias("_at"), F.collect_list("_v").alias("_v")).select("_at", "_v")
    j = len(raters)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(PAIR_SUMS), j, j))
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            lengths = pc.list_value_length(batch.column("_at")).to_numpy()
            at = np.repeat(np.arange(batch.num_rows), lengths), batch.column("_at").flatten().to_numpy()
            x, seen = np.full((batch.num_rows, j), absent or 0.0), np.zeros((batch.num_rows, j))
            x[at], seen[at] = batch.column("_v").flatten().to_numpy(), 1.0
            if absent is not None:
                seen[:] = 1.0
            y = x * x
            total += np.stack([seen.T @ seen, x.T @ seen, seen.T @ x, y.T @ seen, seen.T @ y, x.T @ x])
        if j > 1 and total[0].any():
            a, b = np.triu_indices(j, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(t[a, b]) for t in total]], names=["_a", "_b", *PAIR_SUMS]
            )

    schema = "_a int, _b int, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    sums = rows.mapInArrow(multiply, schema).groupBy("_a", "_b").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS]).where("w > 0")
    names = F.array(*map(F.lit, raters)) if raters else F.array().cast("array<string>")
    return sums.select(names[F.col("_a")].alias("rater_a"), names[F.col("_b")].alias("rater_b"), *PAIR_SUMS)


def correlations(ratings: DataFrame, item: Sequence[str], rater: str, value: str, raters: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every rater pair."""
    sums = _pair_sums(ratings, item, rater, value, raters)
    w, sx, sy = F.col("w"), F.col("sx"), F.col("sy")
    top = w * F.col("sxy") - sx * sy
    bottom = F.sqrt((w * F.col("sxx") - sx * sx) * (w * F.col("syy") - sy * sy))
    return sums.select("rater_a", "rater_b", w.cast("long").alias("n"), F.try_divide(top, bottom).alias("r"))


def profile_distances(profiles: DataFrame, label: str, rater: str, value: str, raters: Sequence[str]) -> DataFrame:
    """Euclidean distance between rater profiles over labels; a label without value counts as 0."""
    sums = _pair_sums(profiles, [label], rater, value, raters, absent=0.0)
    squared = F.col("sxx") + F.col("syy") - 2 * F.col("sxy")
    return sums.select("rater_a", "rater_b", F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))


def with_and_without(
    ratings: DataFrame, item: Sequence[str], rater: str, value: str, subset: Sequence[str], everyone: Sequence[str],
    labels: Sequence, complete: bool = True,
) -> DataFrame:
    """Fleiss' kappa and Krippendorff's alpha for a rater subset beside all raters.

    Kappa is that of items which every rater of the panel labelled; with ``complete=False`` that of all ratings.
    """
    inside = F.col(rater).isin(list(subset))
    panels = F.when(inside, F.array(F.lit("subset"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    tagged = ratings.withColumn("panel", F.explode(panels))
    if complete:
        panel = lambda name, raters: fleiss_complete(
            tagged.where(F.col("panel") == name), item, value, labels, len(raters)
        ).select(F.lit(name).alias("panel"), "kappa")
        kappa = panel("subset", subset).unionByName(panel("all", everyone))
    else:
        kappa = fleiss_available(tagged, item, value, labels, ["panel"]).select("panel", "kappa")
    return kappa.join(krippendorff(tagged, item, value, labels, ["panel"]).select("panel", "alpha"), "panel")
