"""Recovery tests of the iterative models, densities, lexicon and linkage."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from annolytics.operators import irt, lexicon, linkage, topics, trend
from pyspark.sql import functions as F


def simulate(spark, slope, intercept, items=6000, sd=1.0, seed=1):
    rng = np.random.default_rng(seed)
    theta = rng.normal(0, sd, items)
    p = 1 / (1 + np.exp(-(theta[:, None] * slope + intercept)))
    x = rng.random(p.shape) < p
    gone = rng.random(p.shape) < 0.1
    rows = [(i, f"r{j}", None if gone[i, j] else bool(x[i, j])) for i in range(items) for j in range(len(slope))]
    return spark.createDataFrame(rows, "item int, rater string, value boolean")


def test_two_parameter_recovery(spark):
    slope, intercept = np.array([0.8, 1.2, 1.6, 2.0, 1.0]), np.array([-1.0, 0.5, 0.0, -0.5, 1.0])
    df = simulate(spark, slope, intercept)
    model = irt.fit(df, ["item"], "rater", "value", [f"r{j}" for j in range(5)], max_steps=80)
    assert np.abs(model.slope - slope).max() < 0.3 and np.abs(model.intercept - intercept).max() < 0.15
    assert (model.slope_se > 0.02).all() and (model.slope_se < 0.4).all() and (model.intercept_se > 0.02).all()
    assert (np.abs(model.slope - slope) < 4 * model.slope_se).all()
    table = {r.rater: r for r in irt.parameter_table(spark, model, as_cutpoint=True).collect()}
    assert table["r0"].location == pytest.approx(-model.intercept[0] / model.slope[0])
    assert table["r0"].low < table["r0"].location < table["r0"].high
    assert table["r0"].observations == df.where("rater = 'r0' and value is not null").count()


def test_rasch_recovery(spark):
    intercept = np.array([-1.0, 0.5, 0.0, 1.0])
    model = irt.fit(simulate(spark, np.ones(4), intercept, sd=1.5), ["item"], "rater", "value", [f"r{j}" for j in range(4)], rasch=True, max_steps=80)
    assert np.abs(model.intercept - intercept).max() < 0.15 and model.variance == pytest.approx(2.25, abs=0.35)


def test_density_integrates_to_one_and_matches_brute_force(spark):
    xs = [1960, 1960, 1975, 1990, 1991, 2000]
    df = spark.createDataFrame([(x,) for x in xs], "year int")
    got = trend.kernel_density(df, "year", 1900.0, 2060.0, 641).collect()
    assert sum(r.density for r in got) * 0.25 == pytest.approx(1, abs=1e-3)
    x = np.array(xs, dtype=float)
    h = 0.9 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * len(x) ** -0.2
    at = next(r for r in got if r.grid == 1980.0)
    assert at.density == pytest.approx(np.exp(-0.5 * ((1980 - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi)))


def test_density_of_one_value(spark):
    got = trend.kernel_density(spark.createDataFrame([(1.0,)], "x double"), "x", 0.0, 2.0, 3).collect()
    assert all(r.density is not None and not math.isnan(r.density) for r in got)


def test_lexicon_small_and_large_paths_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Love and war. Cold war!"), (2, "nothing"), (3, "")], "id int, text string")
    lex = spark.createDataFrame([("war", "war"), ("war", "cold war"), ("love", "love"), ("love", "love")], "category string, term string")
    small = {(r.id, r.category): (r.hits, r.score) for r in lexicon.category_scores(docs, "id", "text", lex, 2).collect()}
    assert small == {(1, "war"): (3, 0.6), (1, "love"): (1, 0.2)}
    monkeypatch.setattr(lexicon, "BROADCAST_ROWS", 0)
    large = {(r.id, r.category): (r.hits, r.score) for r in lexicon.category_scores(docs, "id", "text", lex, 2).collect()}
    assert large == small
    wide = lexicon.scores_wide(docs, "id", lexicon.category_scores(docs, "id", "text", lex, 2), ["war", "love"])
    assert {r.id: (r.war, r.love) for r in wide.collect()} == {1: (0.6, 0.2), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_nearest_to_seeds_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id int, v array<double>").repartition(7)
    seeds = df.where("id in (3, 9)").withColumn("k", F.col("id").cast("string"))
    got = lexicon.nearest_to_seeds(df, "id", "v", seeds, "k", 4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for s in (3, 9):
        cosine = unit @ unit[s]
        best = [i for i in np.argsort(-cosine) if i != s][:4]
        assert [r.id for r in sorted((r for r in got if r.k == str(s)), key=lambda r: r["rank"])] == best


def test_twenty_thousand_seeds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 4))
    df = spark.createDataFrame(pd.DataFrame({"id": range(20_000), "v": list(x)}), "id int, v array<double>").repartition(4)
    got = lexicon.nearest_to_seeds(df, "id", "v", df.withColumn("k", F.col("id").cast("string")), "k", 2).where("pmod(seed_id, 400) = 0").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 50 * 2
    for r in got:
        cosine = np.round(unit @ unit[r.seed_id], 9)
        cosine[r.seed_id] = -2
        assert r.id == np.lexsort((np.arange(20_000), -cosine))[r["rank"] - 1] and r.k == str(r.seed_id)


def test_trie_walks_words_in_order():
    root = lexicon.build_trie(["a", "a b", "a b c", "b c", "x y"])
    assert lexicon.trie_hits("a b c a b x".split(), root) == {"a": 2, "a b": 2, "a b c": 1, "b c": 1}
    assert lexicon.trie_hits([], root) == {} and lexicon.trie_hits(["x"], root) == {}


def test_phrase_hits_shuffle_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "In the end, the END of it"), (2, "nothing"), (3, None), (4, "the the end")], "id int, t string")
    terms = spark.createDataFrame([("the end",), ("the",), ("end of it",), (None,), ("don't",), ("",)], "term string")
    hits = lexicon.phrase_hits(docs, "id", "t", terms, 2)
    want = {(1, 7, "the end", 2), (1, 7, "the", 2), (4, 3, "the", 2), (4, 3, "the end", 1)}
    assert {tuple(r) for r in hits.collect()} == want
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString().replace("Exchange hashpartitioning(id", "")
    monkeypatch.setattr(lexicon, "BROADCAST_ROWS", 2)
    assert {tuple(r) for r in lexicon.phrase_hits(docs, "id", "t", terms, 2).collect()} == want


def keyed(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_linkage_statuses_and_copies(spark):
    records = keyed(spark, [(i, "the wall song") for i in range(200)] + [(900, "alpha beta"), (901, "quite other words"), (902, "")], "id int, key string")
    catalogue = keyed(spark, [(5, "the wall song"), (2, "the wall song"), (7, "alpha bета"), (8, "alpha betas"), (9, "zz top")], "cand_id int, key string")
    got = {r.id: (r.cand_id, r.match_score) for r in linkage.link(records, catalogue, 0.35).collect()}
    assert len(got) == 203 and all(got[i] == (2, 0.0) for i in range(200))
    assert got[900] == (8, pytest.approx(1 / 11)) and got[901] == (None, None) and got[902] == (None, None)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def best_by_brute_force(keys, entries, distance):
    out = {}
    for key in {k for k in keys if k}:
        scored = [(edits(key, c) / max(len(key), len(c)), i) for c, i in entries if c and abs(len(c) - len(key)) <= distance * max(len(c), len(key)) + 1e-9]
        if near := [x for x in scored if x[0] <= distance]:
            out[key] = min(near)
    return out


def mistyped(draw, text, n):
    for _ in range(n):
        i = draw.randrange(len(text) + 1)
        text = draw.choice([text[:i] + draw.choice("abcdef ") + text[i:], text[:i] + text[i + 1 :], text[:i] + "z" + text[i + 1 :]]) or "a"
    return text


@pytest.mark.parametrize("distance, first, tile", [(0.35, (0.1,), 2000), (0.35, (), 5), (0.2, (0.05, 0.1), 3), (0.6, (0.3,), 50), (0.0, (), 10)])
def test_linkage_finds_every_best_entry(spark, distance, first, tile):
    draw = random.Random(int(distance * 100) + tile)
    word = lambda: "".join(draw.choices("abcdef", k=draw.randrange(1, 5)))
    titles = [" ".join(word() for _ in range(draw.randrange(1, 7))) for _ in range(120)] + ["x" * 70, "ab" * 45, "the " * 25 + "end"]
    entries = [(t, i) for i, t in enumerate(titles + titles[:9])] + [("", 999), (None, 1000)]
    keys = [mistyped(draw, draw.choice(titles), draw.randrange(9)) for _ in range(150)] + ["", "x" * 60, "ab" * 40, "a", "the " * 22 + "and", None, "q" * 5000]
    records = keyed(spark, [(i, k) for i, k in enumerate(keys)], "id int, key string")
    catalogue = keyed(spark, entries, "key string, cand_id int")
    best = linkage.best_matches(records, catalogue, distance, first, tile)
    got = {r.key: (r.match_score, r.cand_id) for r in best.collect()}
    want = best_by_brute_force([k for k in keys if k], [(c, i) for c, i in entries if c], distance)
    assert got == {k: (pytest.approx(s), i) for k, (s, i) in want.items()} and len(want) > (20 if distance else 0)


@pytest.mark.parametrize("sizes", [(1, 3), (7, 2), (40, 1000)])
def test_linkage_compares_blocks_of_like_length_once(spark, sizes):
    """Beyond short distances no segments are indexed; blocks of any size give the same as all pairs, long texts included."""
    draw = random.Random(sizes[0])
    titles = ["".join(draw.choices("abcde \u00e9\U0001F600", k=draw.choice((1, 9, 10, 63, 64, 65, 70, 128, 129, 300)))) for _ in range(60)]
    keys = [mistyped(draw, draw.choice(titles), draw.randrange(25)) for _ in range(60)]
    records, catalogue = keyed(spark, [(k,) for k in keys], "key string"), keyed(spark, [(t, i) for i, t in enumerate(titles)], "key string, cand_id int")
    best = linkage.best_matches(records, catalogue, 0.35, sizes=sizes)
    got = {r.key: (r.match_score, r.cand_id) for r in best.collect()}
    assert got == {k: (pytest.approx(s), i) for k, (s, i) in best_by_brute_force(keys, [(t, i) for i, t in enumerate(titles)], 0.35).items()} and len(got) > 30


def test_linkage_work_per_pair_is_bounded(spark):
    """Texts of two letters share nearly every short segment: each pair is still compared once and a record gives one row."""
    draw = random.Random(4)
    text = lambda: "".join(draw.choices("ab", k=60))
    records, catalogue = keyed(spark, [(text(),) for _ in range(300)], "key string"), keyed(spark, [(text(), i) for i in range(300)], "key string, cand_id long")
    bands = linkage._length_bands(records), linkage._length_bands(catalogue)
    rows = linkage.compared(records, catalogue, 0.35, bands, (100, 100))
    deals = linkage._dealt(records, linkage._blocks(bands[0], 100), linkage._blocks(bands[1], 100), 0.35, "_r", "_e")
    assert deals.count() == 300 * 3 and rows.count() == records.distinct().count()


def test_linkage_with_both_ends_mistyped(spark):
    """Sorted neighbours see neither end; the segment index does."""
    draw = random.Random(8)
    titles = sorted({" ".join("".join(draw.choices("abcdefghijklmnop", k=5)) for _ in range(5)) for _ in range(400)})
    keys = ["zz" + t[2:-2] + "qq" for t in titles]
    records, catalogue = keyed(spark, [(k,) for k in keys], "key string"), keyed(spark, [(t, i) for i, t in enumerate(titles)], "key string, cand_id int")
    got = {r.key: r.cand_id for r in linkage.best_matches(records, catalogue).collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_linkage_of_empty_tables(spark):
    none, some = keyed(spark, [], "key string, cand_id long"), keyed(spark, [("abc", 1)], "key string, cand_id long")
    assert linkage.best_matches(none, some).count() == linkage.best_matches(some, none).count() == 0
    assert linkage.link(some.select("key"), none).collect()[0].cand_id is None


def test_linkage_pages_reach_every_entry(spark):
    records = keyed(spark, [(1, "mmm")], "id int, key string")
    catalogue = keyed(spark, [(i, f"{chr(97 + i)}{chr(97 + i)}{chr(97 + i)}") for i in range(26)], "cand_id int, key string")
    found = [r.cand_id for page in (1, 2, 3, 4, 5, 6, 7) for r in linkage.search(records, catalogue, 5, page, ["forward"]).collect()]
    assert len(found) == len(set(found)) and {10, 11, 12, 13, 14} <= set(found) and len(found) == 26
    with pytest.raises(ValueError, match="51 hits"):
        linkage.search(records, catalogue, 51)
    with pytest.raises(ValueError, match="page 0"):
        linkage.search(records, catalogue, 10, 0)


def test_best_hit_bounds_are_inclusive(spark):
    hits = keyed(spark, [("abcdefghij", "abcdefgxyz", 1), ("aaaaaaaaaa", "aaaaaaaaab", 4), ("aaaaaaaaaa", "baaaaaaaaa", 3)], "key string, cand_key string, cand_id long")
    got = {r.key: (r.cand_id, r.match_score) for r in linkage.best_hits(hits, 0.3).collect()}
    assert got == {"abcdefghij": (1, 0.3), "aaaaaaaaaa": (3, 0.1)}


def test_topic_search_prefers_the_true_number(spark):
    rng = np.random.default_rng(3)
    words = [[f"{c}{i}word" for i in range(12)] for c in "abcd"]
    bag = spark.createDataFrame(
        [(d, w, int(n)) for d in range(300) for w, n in zip(words[d % 4], rng.integers(0, 6, 12)) if n], "id int, term string, n int"
    )
    found = {r.topics: r for r in topics.search_topics(bag, "id", [2, 4], tolerance=1e-5).collect()}
    assert set(found) == {2, 4} and found[4].log_likelihood > found[2].log_likelihood + 0.5
    assert found[4].log_likelihood < -math.log(10) and found[4].coherence is not None and found[4].converged


def test_topics_of_an_empty_corpus(spark):
    bag = spark.createDataFrame([], "id int, term string, n int")
    corpus = topics.corpus(bag, "id")
    model = topics.fit(corpus, 3)
    assert topics.topic_terms(model).count() == topics.document_shares(model, corpus, "id").count() == 0


def test_raters_without_a_finite_maximum_are_named(spark):
    rng = np.random.default_rng(5)
    theta = rng.normal(size=4000)
    rows = []
    for i, x in enumerate(theta):
        votes = [bool(rng.random() < 1 / (1 + np.exp(-(s * x + d)))) for s, d in ((1.0, 0.2), (1.6, -0.5), (0.8, 0.0), (1.2, 0.4))]
        rows += [(i, f"r{j}", v) for j, v in enumerate([*votes, True])]
    df = spark.createDataFrame(rows, "item int, rater string, value boolean")
    model = irt.fit(df, ["item"], "rater", "value", [f"r{j}" for j in range(5)])
    assert model.converged and list(model.bounded) == [True] * 4 + [False] and np.isnan(model.slope[4])
    assert model.slope[:4] == pytest.approx([1.0, 1.6, 0.8, 1.2], abs=0.35) and (model.slope_se[:4] < 0.4).all()
    cuts = spark.createDataFrame([(i, f"c{j}", bool(x > c)) for i, x in enumerate(theta) for j, c in enumerate((-1.0, 0.0, 1.0))], df.schema)
    nested = irt.fit(cuts, ["item"], "rater", "value", ["c0", "c1", "c2"])
    assert not nested.bounded.any() and np.isnan(nested.slope).all()
    table = irt.parameter_table(spark, nested).collect()
    assert all(r.slope is None and r.location is None and not r.bounded and r.observations == 4000 for r in table)


def test_topics_separate_two_vocabularies(spark):
    animal, metal = ["cats", "dogs", "horses", "birds"], ["iron", "copper", "zinc", "silver"]
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(animal if i % 2 else metal, 30))) for i in range(60)]
    df = spark.createDataFrame(docs, "id int, text string")
    bag = topics.bag_of_words(df, "id", "text", topics.stop_words())
    corpus = topics.corpus(bag, "id")
    lda = topics.fit(corpus, [2, 3], tolerance=1e-6)
    assert lda.converged and len(lda.bounds) < 400
    for i in range(2):  # no pass lowers the bound
        bounds = [b[i] for b in lda.bounds]
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:])) and bounds[-1] > bounds[0]
    counts = bag.groupBy("term").agg(F.sum("n").alias("n"))
    assert topics.topic_terms(lda, 3).groupBy("topic").agg(F.sum("phi")).orderBy("topic").collect() == [(i, pytest.approx(1)) for i in (1, 2, 3)]
    shares = {r.id: r.shares for r in topics.document_shares(lda, corpus, "id").collect()}
    assert len(shares) == 60 and all(max(s) > 0.9 and (s[0] > s[1]) == (shares[i % 2][0] > 0.5) for i, s in shares.items())
    wide = topics.labels_wide(topics.labels(topics.term_scores(topics.topic_terms(lda), counts), 4), n=4)
    groups = {frozenset(r[1:]) for r in wide.collect()}
    assert groups == {frozenset(["cat", "dog", "hors", "bird"]), frozenset(["iron", "copper", "zinc", "silver"])}
    picked = topics.overlap_topic(wide, ["IRON", "zinc"]).first().topic
    assert wide.where(F.col("topic") == picked).where("word_1 in ('iron','zinc','copper','silver')").count() == 1


def test_overlap_pick_ties_and_fallback(spark):
    df = spark.createDataFrame([(13, "gun", "die"), (5, "Fight", "war"), (2, "x", "y")], "topic int, word_1 string, word_2 string")
    assert topics.overlap_topic(df, ["gun", "die", "fight", "war"]).first().topic == 5
    assert topics.overlap_topic(df, ["none"]).first().topic == 70


def test_prepare_drops_rare_terms_and_empty_documents(spark):
    bag = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (2, "b", 5), (3, "c", 1)], "id int, term string, n long")
    assert sorted((r.id, r.term, r.n) for r in topics.prepare(bag, "id").collect()) == [(1, "a", 2), (2, "a", 1)]


def test_coherence_by_hand(spark):
    bag = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "a")], "id int, term string").withColumn("n", F.lit(1))
    top = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "topic int, rank int, term string")
    assert topics.coherence(bag, "id", top).first().coherence == pytest.approx(math.log((2 + 1) / 3))


def test_effects_match_least_squares(spark):
    rng = np.random.default_rng(3)
    n = 400
    year, size = rng.uniform(1960, 2020, n), rng.normal(size=n)
    y = 0.3 + 0.002 * (year - 1990) + 0.05 * size + rng.normal(0, 0.01, n)
    rows = [(float(year[i]), float(size[i]), [float(y[i]), float(1 - y[i])]) for i in range(n)]
    model = topics.estimate_effects(spark.createDataFrame(rows, "year double, size double, shares array<double>"), "shares", "year", ["size"])
    x = model.design(year, size[:, None])
    expected, *_ = np.linalg.lstsq(x, np.column_stack([y, 1 - y]), rcond=None)
    assert np.allclose(model.beta, expected, atol=1e-6) and model.documents == n
    curve = topics.effect_curve(model, 1, 11).toPandas()
    assert (curve.lower < curve["mean"]).all() and curve["mean"].iloc[-1] > curve["mean"].iloc[0]


def test_words_keep_inner_dashes_and_lose_typographic_marks(spark):
    docs = spark.createDataFrame([(1, "La-la-la \u2018played\u2019 -- well\u2014known 42nd rock-'n'-roll- -x ok!")], "id int, body string")
    bag = {r.term: r.n for r in topics.bag_of_words(docs, "id", "body").collect()}
    assert bag == {"la-la-la": 1, "play": 1, "wellknown": 1, "rock-n-rol": 1}


def test_bag_of_words_meets_rows_of_one_document(spark):
    """Rows of one id, null ids and null texts; words never leave the task that read them, so no exchange has a word."""
    rows = [(1, "Running cats, the cat"), (1, "cat runs"), (2, None), (None, "cats cats"), (3, "")]
    docs = spark.createDataFrame(rows, "id long, body string")
    bag = topics.bag_of_words(docs, "id", "body", ["the"])
    assert {(r.id, r.term): r.n for r in bag.collect()} == {(1, "run"): 2, (1, "cat"): 3, (None, "cat"): 2}
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert "term#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_grams_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, "a")], "id long, body string")
    grams = lexicon.grams(docs, "id", "body")
    assert sorted(tuple(r) for r in grams.collect()) == [(1, 1, "b", 1), (1, 3, "a", 2), (1, 3, "b", 1), (2, 1, "a", 1)]
    assert "term" not in "".join(x for x in grams._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_passes_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    bag = spark.createDataFrame([(d, f"w{(d * j) % 7}", j) for d in range(20) for j in (1, 2, 3)], "id int, term string, n int").groupBy("id", "term").agg(F.sum("n").alias("n"))
    corpus, before = topics.corpus(bag, "id"), spark.conf.get(name)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    added = []
    for passes in (1, 4):
        start = files()
        topics.fit(corpus, 2, passes, tolerance=0.0)
        added.append(len(files() - start))
    assert added[1] <= added[0] and spark.conf.get(name) == before
