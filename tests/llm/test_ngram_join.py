"""The n-gram join against brute force over all pairs."""

import random

import numpy as np
import pytest
from annolytics.llm import ngram_join
from annolytics.llm.components import components
from annolytics.llm.queries import QUERIES
from conftest import SMALL


def tokens(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def by_hand(rows, k, percent):
    sets = [tokens(t, k) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    small = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(
        ((d, len(s), small[root(i)], n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))), key=str
    )


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=str)


def corpus(seed, groups=8, lines=3):
    """Families of edited copies of all lengths, shared lines, very short texts and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    shared = [" ".join(word() for _ in range(14)) for _ in range(lines)]
    texts = ["", None, " \t\n ", "one", "one", "One TWO", "one two", "one two three", "one\xa0two three"]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([5, 9, 11, 14, 22, 40, 90, 300]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:12]) + " " + rng.choice(shared))
    texts += [rng.choice(shared) + " " + " ".join(word() for _ in range(rng.randint(0, 3))) for _ in range(12)]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3])]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 2, 60)])
def test_components_and_links(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.join(df, words=k, percent=percent)) == by_hand(rows, k, percent)


def test_with_frequent_tokens_and_many_blocks(spark, monkeypatch):
    """Every token that three texts share counts as frequent, and families are cut in blocks of five."""
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = corpus(7, groups=10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.join(df)) == by_hand(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        lose, gain = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
        b = np.unique(np.append(a[lose:], rng.integers(0, 1 << 63, gain).astype(np.uint64)))
        a = np.unique(a)
        often = np.unique(rng.choice(a, int(rng.integers(0, n + 1))))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            keys = [set(ngram_join.prefix_keys(x, often, percent).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_small_subsets_of_frequent_tokens_share_a_key(percent):
    """Every pair of sizes about the bound for short sets, with all tokens frequent."""
    rng = np.random.default_rng(percent)
    for large in range(2, 30):
        for small in range(-(-percent * large // 100), large + 1):
            for _ in range(20):
                b = np.unique(rng.integers(0, 1 << 63, large).astype(np.uint64))
                a = np.sort(rng.choice(b, small, replace=False))
                keys = [set(ngram_join.prefix_keys(x, b, percent).tolist()) for x in (a, b)]
                assert keys[0] & keys[1], (small, large)


def test_short_subset_of_a_text_copied_many_times(spark):
    """12 of 15 shingles are 80 %, and all 15 are in 65 texts or more."""
    words = [f"w{i}" for i in range(19)]
    rows = [(i, " ".join(words)) for i in range(65)] + [(i, " ".join(words[:16])) for i in range(65, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.join(df, words=5, percent=80)) == by_hand(rows, 5, 80)


def test_null_ids_clashing_columns_and_empty_table(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (None, "x y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as n", "3 as th", "4 as component_id")
    assert result(ngram_join.join(df)) == by_hand(rows, 3, 90)
    assert ngram_join.join(df.limit(0)).collect() == []
    assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(df).collect()) == [(0, ""), (0, "x y z"), (4, "a b c d e f g")]
    assert ngram_join.one_of_each(df).columns == df.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    assert {(r.node, r.root) for r in components(df).collect()} == (
        {(i, 1) for i in range(1, 41)} | {(i, 100) for i in range(100, 130)} | {(200, 200), (201, 200)}
    )


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op2_ngram_join"](spark, SMALL)) == by_hand(rows, 3, 90)


def test_one_of_each_keeps_columns_that_clash(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 5, 6), (2, text, 5, 6), (3, "alone", 5, 6), (4, None, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th int, _row int")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_as_many_keys_as_they_say(percent):
    rng = np.random.default_rng(percent)
    most = 0
    for _ in range(600):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        lose, gain = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
        b = np.unique(np.append(a[lose:], rng.integers(0, 1 << 63, gain).astype(np.uint64)))
        a = np.unique(a)
        often = np.unique(rng.choice(a, int(rng.integers(0, n + 1))))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            (x, m), (y, n) = (ngram_join.sure_keys(s, often, percent) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= min(m, n) >= 1
            most = max(most, min(m, n))
    assert most == ngram_join.SURE


def test_chains_of_chance_do_not_multiply_sets(spark, monkeypatch):
    """120 pairs of copies, each pair with one shingle of the next: 240 sets, of which a block holds five."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    sent = []

    def counted(links):
        sent.append(links.count())
        return components(links)

    monkeypatch.setattr(ngram_join, "components", counted)
    texts = []
    for i in range(120):
        base = [f"a{i}w{j}" for j in range(100)]
        base[40:43] = [f"s{i}a", f"s{i}b", f"s{i}c"]
        base[60:63] = [f"s{i + 1}a", f"s{i + 1}b", f"s{i + 1}c"]
        texts += [" ".join(base), " ".join([*base, "end"])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = result(ngram_join.join(df))
    assert found == sorted(((i, 98 + i % 2, i - i % 2, 1) for i, _ in rows), key=str)
    assert sent[-1] == 240  # a row for each set that a group of two blocks gets
