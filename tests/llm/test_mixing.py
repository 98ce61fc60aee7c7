"""Pfair mixing: windows, deviation, completeness, and the registered query against SQL."""

from collections import Counter, defaultdict

import oracle
import pytest
from annolytics.llm import mixing
from annolytics.llm.queries import ORACLE_SQL, QUERIES
from conftest import SMALL


def frame(spark, sizes):
    rows = [(f"{s}-{i}", s, f"text {s} {i}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(3)


@pytest.mark.parametrize(("weights", "sizes"), [
    ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 90, "b": 33, "c": 20}), ({"a": 1.0}, {"a": 7}), ({"a": 3, "b": 1}, {"a": 5, "b": 64}),
    ({"a": 0.6, "b": 0.39}, {"a": 30, "b": 17, "x": 3, "y": 2}), ({"a": 0.98, "b": 0.01, "gone": 0.01}, {"a": 40, "b": 9}),
])
def test_windows_and_deviation(spark, weights, sizes):
    rows = mixing.schedule(frame(spark, sizes), weights, block=4, period=100).collect()
    slots = sorted({(r.slot, r.stream, r.block, r["pass"]) for r in rows})
    assert [s[0] for s in slots] == list(range(len(slots)))  # every slot has one block
    assert all(r.release <= r.slot < r.deadline for r in rows)
    counts = Counter(s[1] for s in slots)
    asked = {s: weights.get(s, 0.01) for s in counts}
    share = mixing.shares(asked, 100)
    done = defaultdict(int)
    for n, (_, stream, _, _) in enumerate(slots, 1):
        done[stream] += 1
        for s in asked:
            assert abs(done[s] - n * share[s] / sum(share.values())) < 1
    once = [r.doc_id for r in rows if r["pass"] == 0]
    assert sorted(once) == sorted(f"{s}-{i}" for s, n in sizes.items() for i in range(n))  # nothing is left out
    passes = defaultdict(set)
    for r in rows:
        passes[r.doc_id].add(r["pass"])
    assert all(p == set(range(len(p))) for p in passes.values())


def test_shares():
    assert mixing.shares({"a": 0.5, "b": 0.3, "c": 0.2}, 10) == {"a": 5, "b": 3, "c": 2}
    tiny = mixing.shares({"a": 1.0, **{f"t{i}": 1e-9 for i in range(20)}}, 10)
    assert sum(tiny.values()) == 21 and min(tiny.values()) == 1
    assert sum(mixing.shares({c: 1 for c in "abcdefg"}, 100).values()) == 100


def test_defined_cases(spark):
    rows = [(None, None, "x", 1), (None, None, "x", 1), (1, "a", None, 2), (1, "a", None, 2), (2, "rest", "", 3), (3, "a", "t" * 100_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int").selectExpr("*", "1 as stream", "2 as _w")
    got = mixing.schedule(df, {"a": 0.5}, rest=0.5).collect()
    assert len([r for r in got if r["pass"] == 0]) == 6 and {r.stream for r in got} == {"a", "rest"}
    mixed = mixing.mix(df, {"a": 0.5}, rest=0.5)
    assert mixed.columns == df.columns
    assert Counter(tuple(r) for r in mixed.collect()) == Counter(tuple(r) for r in df.collect())
    assert mixing.schedule(df.limit(0), {"a": 0.5}).collect() == [] == mixing.mix(df.limit(0), {"a": 0.5}).collect()


def test_mix_is_in_order(spark):
    df = frame(spark, {"a": 64, "b": 64})
    rows = mixing.mix(df, {"a": 0.5, "b": 0.5}, block=1, period=2).collect()
    assert [r.source for r in rows] == ["a", "b"] * 64


def test_one_block_beside_a_large_source(spark, monkeypatch):
    """The one block of a small source is read over and over; its copies share the slots between them."""
    df = frame(spark, {"big": 4000, "one": 1})
    want = sorted(tuple(r) for r in mixing.schedule(df, {"big": 0.9, "one": 0.1}, block=1, period=10).collect())
    assert sum(r[1] == "one" for r in want) == 4000 // 9
    monkeypatch.setattr(mixing, "READINGS", 7)
    plan = mixing.schedule(df, {"big": 0.9, "one": 0.1}, block=1, period=10)
    assert sorted(tuple(r) for r in plan.collect()) == want
    assert "sequence(_block" not in plan._jdf.queryExecution().toString()


def test_names_that_clash(spark):
    names = ["_slot", "_within", "_row", "_row2", "_n", "_doc", "_id", "_block", "_kept", "slot"]
    df = frame(spark, {"a": 9, "b": 3}).selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    mixed = mixing.mix(df, {"a": 0.5, "b": 0.5}, block=1, period=2)
    assert mixed.columns == df.columns and {tuple(r) for r in mixed.collect()} == {tuple(r) for r in df.collect()}
    kept = mixing.schedule(df, {"a": 0.5, "b": 0.5}, block=1, keep=["_slot", "text"]).collect()
    assert {(r["_slot"], r.text) for r in kept} == {(0, r.text) for r in df.collect()}


def test_places_survive_many_files_in_any_order(spark, tmp_path):
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    df = frame(spark, {"a": 300, "b": 200, "c": 5})
    want = sorted((r.slot, r.within, r.doc_id) for r in mixing.schedule(df, weights, block=4, period=100).collect())
    folder = str(tmp_path / "mixed")
    mixing.mix(df, weights, block=4, period=100).repartition(64).write.parquet(folder)
    stored = spark.read.parquet(folder)
    assert stored.columns == df.columns
    placed = mixing.places(stored, weights, block=4, period=100)
    assert sorted((r.slot, r.within, r.doc_id) for r in placed.collect()) == want
    more = mixing.places(stored.unionByName(stored.limit(1)), weights, block=4, period=100)
    assert more.count() == len(want) + 1 and more.where("slot is null").count() == 1
    again = mixing.places(stored, weights, block=4, period=100)
    moves = [line for line in again._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(_row" in line]
    assert len(moves) == 1  # texts are shuffled once


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op7_pfair_mixing"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_against_sql(spark, folder):
    name = "op7_pfair_mixing"
    assert oracle.compare(QUERIES[name](spark, folder), oracle.connect(folder), ORACLE_SQL[name]) == []
