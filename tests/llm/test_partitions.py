"""Learned partitions against brute force."""

import numpy as np
from annolytics.llm import partitions
from annolytics.llm.queries import QUERIES
from conftest import SMALL
from pyspark.sql import functions as F


def brute(rows, asks, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in good:
        if asks(q):
            near = [(-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), i) for i, y in good if i != q]
            near = sorted((round(s, 9), i) for s, i in near)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def same(a, b):
    return [r[:3] for r in a] == [r[:3] for r in b] and np.allclose([r[3] for r in a], [r[3] for r in b], atol=2e-9)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_one_part_is_exact_with_defined_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(f) for f in np.float32(rng.normal(size=4))]) for i in range(60)]
    rows += [(100, [0.0] * 4), (101, None), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (105, [])]
    rows += [(200 + i, [2.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(0, rows[0][1]), (300, [1e30, 1e30, 0.0, 0.0]), (301, [1e-30, 1e-30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as part")
    got = result(partitions.search(df, F.col("vec_id") % 5 == 0))
    want = brute(rows, lambda q: q % 5 == 0)
    once = [r for r in want if r[0] != 0]
    assert same([r for r in got if r[0] != 0], once)
    assert partitions.search(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert partitions.search(df.where("vec_id in (1, 5)"), F.col("vec_id") == 5).count() == 1
    assert partitions.search(df.where("vec_id = 5"), F.col("vec_id") == 5).count() == 0


def test_cells_and_piles_change_nothing(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = result(partitions.search(df, F.col("vec_id") % 7 == 0))
    monkeypatch.setattr(partitions, "CELL", 60)
    monkeypatch.setattr(partitions, "BATCH", 9)
    assert result(partitions.search(df, F.col("vec_id") % 7 == 0)) == want


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(2)
    x = partitions.units(np.repeat(rng.normal(size=(8, 16)), 100, axis=0) + 0.2 * rng.normal(size=(800, 16)))
    part = partitions.balanced_parts(x, partitions.neighbour_graph(x), 8, rng)
    assert np.bincount(part, minlength=8).max() <= 110 and np.bincount(part, minlength=8).min() > 0
    router, tries = partitions.fit(x[rng.permutation(800)], 8, 0.95, 5)
    assert tries <= 4 and router.scores(x).shape == (800, 8)


def test_recall_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(partitions, "PER_PART", 150)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = result(partitions.search(df, F.col("vec_id") % 50 == 0))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda q: q % 50 == 0)
    pairs = {(q, i) for q, _, i, _ in want}
    assert len({(q, i) for q, _, i, _ in got} & pairs) >= 0.9 * len(pairs) and len(got) == len(want)


def test_query_is_exact_on_small_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert same(result(QUERIES["op8_learned_partitions"](spark, SMALL)), brute(rows, lambda q: q % 50 == 0))


def test_rows_of_a_repeated_id_are_queries_and_candidates_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = partitions.search(df, F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(50, 1, 50, 1.0)] * 2 + [(50, 2, 3, 0.0)] * 2
