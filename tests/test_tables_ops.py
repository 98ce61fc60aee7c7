"""De-duplication, numbering, bins, reshaping, joins, samples."""

import hashlib
import random

import numpy as np
import pytest
from annolytics.operators import aggregate, dedupe, relational, reshape, sample, windows
from pyspark.sql import functions as F


def test_first_per_key_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 0.2, 9), (1, 0.2, 7), (2, None, 3), (None, 0.5, 1)], "k int, s double, id int")
    got = {(r.k, r.s, r.id) for r in dedupe.first_per_key(df, ["k"], ["s", "id"]).collect()}
    assert got == {(1, 0.2, 7), (2, None, 3), (None, 0.5, 1)}
    assert [r.id for r in dedupe.best_scored_per_key(df, ["k"], "s", 0.3, ["id"]).collect()] == [7]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = dedupe.first_per_key(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_number_rows_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, id int").repartition(6)
    got = windows.number_rows(df, ["x", "id"], ["g"], "rn").collect()
    expected, seen = {}, {}
    for g, x, i in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    assert {r.id: r.rn for r in got} == expected
    total = windows.number_rows(df, ["x", "id"], name="rn").collect()
    assert [r.id for r in sorted(total, key=lambda r: r.rn)] == [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_running_total(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"), (F.col("id") % 3).alias("v"))
    got = {r.x: r.t for r in windows.running_total(df, ["x"], F.col("v"), "t").collect()}
    run = 0
    for r in sorted(df.collect()):
        run += r.v
        assert got[r.x] == run


def test_batches_per_group(spark):
    df = spark.range(23).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 2 == 0, 5).otherwise(3).alias("size"))
    got = windows.batch_ids(df, ["id"], "size", ["g"]).groupBy("g", "batch").count().collect()
    assert {(r.g, r.batch): r["count"] for r in got} == {(0, 1): 5, (0, 2): 5, (0, 3): 2, (1, 1): 3, (1, 2): 3, (1, 3): 3, (1, 4): 2}


def test_cut_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.2, 0.21, 1.0, None)], "x double")
    assert {r.bin: r.n for r in windows.cut_counts(df, "x", 5).collect()} == {1: 2, 2: 1, 5: 1}
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in windows.cut_counts(same, "x", 5).collect()] == [(3, 2)]
    assert windows.cut_counts(df.where("x > 5"), "x", 5).count() == 0


def test_first_maximum_and_letters(spark):
    df = spark.createDataFrame([(5, 2), (13, 2), (1, 0)], "topic int, hits int")
    assert windows.first_maximum(df, "topic", "hits", 70).first()[0] == 5
    assert windows.first_maximum(df.where("hits = 0"), "topic", "hits", 70).first()[0] == 70
    many = spark.range(800).select(F.format_string("%04d", F.col("id")).alias("c"))
    got = [r.a for r in windows.letter_aliases(many, "c", "a").orderBy("c").collect()]
    assert got[:2] == ["A", "B"] and got[25:28] == ["Z", "AA", "AB"] and got[701:703] == ["ZZ", "AAA"]


def test_lump_keeps_ties_and_nulls(spark):
    rows = ["a"] * 3 + ["b"] * 2 + ["c"] * 2 + ["d"] + [None]
    df = spark.createDataFrame([(x,) for x in rows], "l string")
    got = {r.l: r["count"] for r in reshape.lump_rare(df, "l", 2).groupBy("l").count().collect()}
    assert got == {"a": 3, "b": 2, "c": 2, "Other": 1, None: 1}


def test_presence_modes(spark):
    df = spark.createDataFrame([(1, "r1", "x"), (1, "r1", "x"), (1, "r2", None), (2, "r2", "zz")], "i int, r string, l string")
    seen = {(r.i, r.r, r.l): r.present for r in reshape.presence(df, ["i"], "r", "l", ["x", "y"]).collect()}
    assert seen == {(1, "r1", "x"): 1, (1, "r1", "y"): 0, (1, "r2", "x"): 0, (1, "r2", "y"): 0, (2, "r2", "x"): 0, (2, "r2", "y"): 0}
    filled = reshape.presence(df, ["i"], "r", "l", ["x", "y"], ["r1", "r2"])
    assert filled.count() == 8 and filled.agg(F.sum("present")).first()[0] == 1


@pytest.mark.parametrize(("raw", "kind", "out"), [
    (["true", "null", None], "boolean", [True, None, None]), (["1", "2.5e0", "null"], "double", [1.0, 2.5, None]),
    (['"a"', "1", "true"], "string", ["a", "1", "true"]), (["[1]", "2", "3"], "string", ["[1]", "2", "3"]),
])
def test_simplified_variants(spark, raw, kind, out):
    df = reshape.simplify_variants(spark.createDataFrame([(x,) for x in raw], "v string").coalesce(1), "v")
    assert df.schema["v"].dataType.simpleString() == kind
    assert [r.v for r in df.collect()] == out


def test_salted_lookup_equals_join(spark):
    facts = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), "id")
    dim = facts.select("k").distinct().where("k <> 'k1'").withColumn("v", F.upper("k"))
    expected = sorted((r.k, r.id, r.v) for r in facts.join(dim, "k", "left").select("k", "id", "v").collect())
    got = sorted((r.k, r.id, r.v) for r in relational.salted_lookup(facts, dim, "k").select("k", "id", "v").collect())
    key = lambda t: (t[0], t[1], t[2] or "")
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_salted_lookup_parts_hot_keys_by_their_share_and_spreads_null_keys(spark):
    key = F.when(F.col("id") % 2 == 0, F.lit(None).cast("string")).when(F.col("id") % 8 != 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    facts = spark.range(40_000).select(key.alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    joined = relational.salted_lookup(facts, dim, "k")
    assert joined.count() == 40_000
    assert {r[0]: r[1] for r in joined.groupBy("v").count().collect()} == {1: 15_000, 2: 1_000, None: 24_000}
    pieces = F.count_distinct("_p")
    spread = joined.withColumn("_p", F.spark_partition_id()).groupBy(F.coalesce("k", F.lit("-")).alias("k")).agg(pieces.alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert {r.k: r.n for r in spread.where("k in ('-', 'hot')").collect()} == {"-": 4, "hot": 4}  # all four partitions
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_cross_with_dimension_and_resume(spark):
    items = spark.range(3)
    crossed = relational.cross_with_dimension(items, [{"m": "a", "p": {"k": "v"}}, {"m": "b", "p": {}}], "m string, p map<string,string>")
    assert crossed.count() == 6 and crossed.where("m = 'a'").first().p == {"k": "v"}
    done = crossed.where("id = 0 or m = 'a'").select("id", "m")
    assert sorted((r.id, r.m) for r in relational.unfinished(crossed, done, ["id", "m"]).collect()) == [(1, "b"), (2, "b")]


def test_samples_are_repeatable_and_bounded(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 7, "small").otherwise("big"))
    one = sorted(r.id for r in sample.simple(df, "id", 20, 1).collect())
    assert one == sorted(r.id for r in sample.simple(df.repartition(5), "id", 20, 1).collect()) and len(one) == 20
    strata = {"low": F.col("id") < 7, "rest": F.col("id") >= 500}
    counts = {r.stratum: r["count"] for r in sample.stratified(df, strata, "id", 300, 1).groupBy("stratum").count().collect()}
    assert counts == {"low": 7, "rest": 300}


def test_rollup_year_is_taken_at_the_best_rank(spark):
    rows = [("s", "a", 5, "1990-01-01"), ("s", "a", 2, "1991-01-01"), ("s", "a", 2, "1993-01-01"), ("s", "a", 9, "1999-01-01"), ("s", "b", 1, "1980-01-01")]
    df = spark.createDataFrame(rows, "song string, artist string, rank int, d string").withColumn("d", F.to_date("d"))
    got = {(r.song, r.artist): (r.weeks, r.top, r.year) for r in aggregate.entity_rollup(df, ["song", "artist"], "rank", "d").collect()}
    assert got == {("s", "a"): (4, 2, 1993), ("s", "b"): (1, 1, 1980)}


def _cost(mode, cost, price, flag, disc=0.5, cached_price=0.5):
    """The cost rule by hand, for 1M input (0.4M cached) and 1M output tokens at 1.0 in, 2.0 out."""
    cost = cost or 0.0
    if cost == 0 and price:
        base = 0.6 * 1.0 + 0.4 * (1.0 if cached_price is None else cached_price) + 2.0
        if mode != "batch":
            return base
        return (base if flag in (True, None) else 3.0) * (1 if disc is None else disc)
    return cost / 2 if mode == "batch" else cost


def test_cost_cases(spark):
    cases, prices = [], []
    for mode in ("batch", "parallel"):
        for cost in (None, 0.0, 7.0):
            for price in (True, False):
                for flag in (True, False, None):
                    for disc, cached_price in ((0.5, 0.5), (None, None)):
                        name = f"m{len(cases)}"
                        cases.append((name, mode, 1e6, 4e5, 1e6, cost, _cost(mode, cost, price, flag, disc, cached_price)))
                        if price:
                            prices.append((name, 1.0, 2.0, cached_price, disc, flag))
    schema = "model string, processing string, input_tokens double, cached_input_tokens double, output_tokens double, cost double"
    use = spark.createDataFrame([c[:6] for c in cases], schema)
    pricing = spark.createDataFrame(prices, "model string, input_per_m double, output_per_m double, cached_input_per_m double, batch_discount_factor double, cache_discounts_with_batch boolean")
    got = {r.model: r.cost for r in aggregate.estimated_costs(use, pricing).collect()}
    assert got == {c[0]: pytest.approx(c[6]) for c in cases}


def test_null_sums_are_zero(spark):
    df = spark.createDataFrame([("a", None, None)], "model string, flag boolean, tokens double")
    assert aggregate.usage_totals(df, ["model"]).first().tokens == 0.0
    assert aggregate.rates(df, ["model"], "flag").first().positives == 0


def test_exact_quantiles_of_hot_and_small_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(x)) for x in rng.integers(0, 3000, 9000)] + [("few", 2.0), ("few", 9.0), ("one", 5.0), ("none", None), (None, 1.5), (None, 2.5)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = {"low": 0.25, "median": 0.5, "high": 0.9}
    got = {r.g: r for r in windows.quantiles(df, ["g"], "x", shares).collect()}
    for g in {r[0] for r in rows} - {"none"}:
        own = [x for h, x in rows if h == g]
        assert [got[g][c] for c in shares] == pytest.approx([np.quantile(own, s) for s in shares.values()])
    assert "none" not in got
    whole = windows.quantiles(df, [], "x", {"median": 0.5}).collect()
    assert [r.median for r in whole] == [pytest.approx(np.median([x for _, x in rows if x is not None]))]
    weighted = spark.createDataFrame([("a", 1.0, 3), ("a", 8.0, 1)], "g string, x double, n long")
    assert windows.quantiles(weighted, ["g"], "x", {"q": 0.75}, "n").first().q == pytest.approx(np.quantile([1, 1, 1, 8], 0.75))


@pytest.mark.parametrize("n", [1, 1500])
def test_samples_beyond_the_rank_limit(spark, n):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 100 == 0, "small").when(F.col("id") % 100 < 40, "mid").otherwise("hot").alias("g"))
    got = sample.per_group(rows, ["g"], "id", n, 7)
    order = sorted(((r.g, hashlib.md5(f"{r.id}7".encode()).hexdigest(), r.id) for r in rows.collect()))
    want = {(g, i) for g in ("small", "mid", "hot") for _, _, i in [r for r in order if r[0] == g][:n]}
    assert {(r.g, r.id) for r in got.collect()} == want


def test_no_stratum_is_ranked_whole(spark):
    """At 5,000 a group, about 5,000 rows of the large group reach the ranking, not all of them."""
    rows = spark.range(200_000).select("id", F.when(F.col("id") < 500, "tiny").otherwise("hot").alias("g"))
    cut = sample.cut_groups(rows, ["g"], "id", 5000, 3)
    counts = {r.g: r["count"] for r in cut.groupBy("g").count().collect()}
    assert counts["tiny"] == 500 and 5000 <= counts["hot"] < 7000
    assert sample.per_group(rows, ["g"], "id", 5000, 3).count() == 5500
