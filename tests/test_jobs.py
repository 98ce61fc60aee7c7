"""Configuration, annotation jobs, sinks, releases and incremental runs."""

import hashlib
import json
import shutil
import sys

import pytest
from annolytics.operators import annotate, publish
from annolytics.operators.aggregate import entity_rollup
from annolytics.session import broadcast_if_small, new_path, shared_dir
from annolytics.sources import sinks, tables
from annolytics.streaming import incremental
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATERS = [
    {"api": "x", "model": "good", "chat_function": "f", "params": {"p": "1"}, "processing": "sequential", "prompt_batch_size": 3},
    {"api": "x", "model": "bad", "chat_function": "f", "params": {}, "processing": "sequential", "prompt_batch_size": 4},
]


def scorer(prompts, model, params):
    if model == "bad" and any("7" in p for p in prompts):
        raise RuntimeError("boom")
    return [{"response": json.dumps({"about_politics": len(p) % 2 == 0, "justification": p, "confidence_score": 0.5}), "input_tokens": len(p)} for p in prompts]


def prompted(spark, n=10):
    items = spark.range(n).withColumn("t", F.concat(F.lit("text "), "id"))
    return annotate.prompts(items.unionByName(items), "Say: {{t}}", {"t": F.col("t")})


def test_work_list_batches_distinct_prompts(spark):
    work = annotate.work_list(prompted(spark), RATERS)
    counts = {(r.model, r.batch): r["count"] for r in work.groupBy("model", "batch").count().collect()}
    assert counts == {("good", 1): 3, ("good", 2): 3, ("good", 3): 3, ("good", 4): 1, ("bad", 1): 4, ("bad", 2): 4, ("bad", 3): 2}


def test_failed_batch_is_isolated(spark):
    out = annotate.score(prompted(spark), RATERS, scorer, slices=1)
    rows = out.collect()
    assert len(rows) == 20
    bad = [r for r in rows if r.error]
    assert {r.model for r in bad} == {"bad"} and 2 <= len(bad) <= 4 and all(r.response is None for r in bad)
    parsed = annotate.parse_flag(out).where("error is null")
    assert parsed.where("invalid").count() == 0 and parsed.where("input_tokens is null").count() == 0


def test_resumed_job_equals_one_shot(spark):
    whole = annotate.score(prompted(spark), RATERS[:1], scorer)
    half = spark.createDataFrame(whole.collect()[:4], annotate.RESPONSE_SCHEMA)
    rest = annotate.score(prompted(spark), RATERS[:1], scorer, half)
    assert rest.count() == 6
    key = lambda df: sorted((r.prompt_digest, r.model, r.response) for r in df.collect())
    assert key(half.unionByName(rest)) == key(whole)


@pytest.mark.parametrize(("answer", "invalid"), [
    ('{"about_politics": true, "justification": "j", "confidence_score": 0.5}', False), ('{"about_politics": true}', True),
    ('{"about_politics": true, "confidence_score": 1.5}', True), ("not json", True),
])
def test_flag_answers(spark, answer, invalid):
    assert annotate.parse_flag(spark.createDataFrame([(answer,)], "response string")).first().invalid is invalid


@pytest.mark.parametrize(("themes", "invalid"), [(["a"], False), ([], True), (None, True), (["a", "q"], True), (["a"] * 5, True)])
def test_theme_answers(spark, themes, invalid):
    df = spark.createDataFrame([(json.dumps({"themes": themes}),)], "response string")
    assert annotate.parse_themes(df, ["a", "b"]).first().invalid is invalid


def test_group_digest_parts_are_whole(spark):
    df = spark.createDataFrame([("g", i, f"r{i}") for i in range(7)] + [("g", 7, "  ")], "g string, i int, t string")
    parts = sorted(annotate.group_digest(df, "g", ["i"], "t", 3).collect(), key=lambda r: r.part)
    assert "\n".join(p.digest for p in parts) == "\n".join(f"{i + 1}. r{i}" for i in range(7)) and len(parts) == 3


def test_markdown_escapes(spark):
    dim = spark.createDataFrame([("b", "x|y"), ("a", "l1\nl2")], "category string, description string")
    rows = annotate.markdown_table(dim, ["category", "description"], "category", rows_per_part=1).orderBy("part").collect()
    assert [r.part for r in rows] == [1, 2]
    table = "\n".join(r.table for r in rows)
    assert table.split("\n")[2:] == ["| a | l1 l2 |", "| b | x\\|y |"]


def test_rater_config_inheritance():
    rows = tables.raters_from_config({
        "s": {"chat_function": "chat_openai", "processing": "batch", "prompt_batch_size": 9, "params": {"a": 1, "b": 2},
              "models": ["plain", {"name": "own", "processing": "parallel", "prompt_batch_size": 2.0, "params": {"b": 3}}, {"name": "off", "enabled": False}, {"name": ""}]},
        "d": {"chat_function": "other", "models": [{"model": "alias"}]}, "empty": {"chat_function": "other"},
    })
    assert [(r["model"], r["processing"], r["prompt_batch_size"], r["params"]) for r in rows] == [
        ("plain", "batch", 9, {"a": "1", "b": "2"}), ("own", "parallel", 2, {"a": "1", "b": "3"}), ("alias", "sequential", 5, {}),
    ]


@pytest.mark.parametrize("service", [
    {"chat_function": "f", "models": [{"name": "m", "processing": "later"}]},
    {"chat_function": "f", "models": [{"name": "m", "processing": "batch"}]},
    {"chat_function": "f", "models": [{"name": "m", "prompt_batch_size": 0}]},
    {"chat_function": "f", "models": [{"name": "m", "prompt_batch_size": "x"}]},
])
def test_bad_rater_config(service):
    with pytest.raises(ValueError, match="s/m"):
        tables.raters_from_config({"s": service})


def test_chart_scan(spark, tmp_path):
    path = tmp_path / "chart.csv"
    path.write_text('Date,Song,Artist,Rank,Last Week,Peak Position,Weeks in Charts,Image URL\n2020-01-04,"A, ""b""",X,1,,1,-,#\n2020-01-11,B,Y,2,3,2,7,http://u\n')
    rows = sorted(tables.read_chart(spark, str(path)).collect(), key=lambda r: r.rank)
    assert rows[0].song == 'A, "b"' and rows[0].weeks_in_charts is None and rows[0].image_url is None and rows[0].last_week is None
    assert rows[1].weeks_in_charts == 7 and rows[1].image_url == "http://u"


def test_paired_sink_round_trip(spark):
    df = spark.createDataFrame([(1, None, ["a"], 'q"x\ny'), (2, "", [], "z")], "id int, s string, l array<string>, t string")
    paths = sinks.write_pair(df, new_path(spark, "pair"))
    assert sorted(map(tuple, spark.read.parquet(paths["parquet"]).collect())) == sorted(map(tuple, df.collect()))
    back = {r.id: r for r in tables.read_csv(spark, paths["csv"], "id int, s string, l string, t string", line_breaks_in_fields=True).collect()}
    assert back[1].s is None and back[1].l == '["a"]' and back[1].t == 'q"x\ny'


def test_release_guards(spark):
    df = spark.createDataFrame([("bob", "secret", 1), ("amy", "x", 2)], "name string, lyrics string, v int")
    with pytest.raises(ValueError, match="lyrics"):
        publish.assert_absent(df, ["lyrics", "url"], "t")
    out = publish.pseudonymise(df, "name", ["lyrics"])
    assert sorted(out.columns) == ["coder", "v"] and {r.v: r.coder for r in out.collect()} == {1: "Coder B", 2: "Coder A"}


def test_content_hash_ignores_order_but_not_copies(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    digest = lambda d: d.agg(publish.content_hash(d)).first()[0]
    assert digest(df) == digest(df.repartition(7).select("x", "id"))
    assert digest(df) != digest(df.unionByName(df)) and digest(df.unionByName(df)) != digest(df.limit(0))


def _chart(spark):
    rows = [(f"s{i % 5}", f"a{i % 3}", i % 17 + 1, f"{1990 + i % 9}-01-01") for i in range(300)]
    return spark.createDataFrame(rows, "song string, artist string, rank int, d string").withColumn("d", F.to_date("d"))


def test_streamed_rollup_equals_batch(spark, tmp_path):
    chart, keys = _chart(spark), ["song", "artist"]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    expected = sorted(map(tuple, entity_rollup(chart, keys, "rank", "d").collect()))
    for part in range(3):
        chart.where(F.pmod(F.hash("rank"), F.lit(3)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(chart.schema).option("maxFilesPerTrigger", 2).parquet(source)
        incremental.stream_rollup(stream, state, keys, "rank", "d")
    assert sorted(map(tuple, incremental.read_rollup(spark, state, keys).collect())) == expected
    incremental.compact_rollup(spark, state, str(tmp_path / "compact"), keys)
    assert sorted(map(tuple, incremental.read_rollup(spark, str(tmp_path / "compact"), keys).collect())) == expected


def test_streamed_annotation_scores_each_pair_once(spark, tmp_path):
    work = prompted(spark).select("prompt_digest", "prompt")
    source, results = str(tmp_path / "in"), str(tmp_path / "out")
    calls = spark.sparkContext.accumulator(0)

    def counted(prompts, model, params):
        calls.add(len(prompts))
        return scorer(prompts, model, params)

    for _ in range(2):
        work.write.mode("append").parquet(source)
        incremental.stream_annotation(spark.readStream.schema(work.schema).parquet(source), results, RATERS[:1], counted)
    stored = incremental.read_annotations(spark, results)
    assert stored.count() == 10 and stored.select("prompt_digest").distinct().count() == 10 and calls.value == 10


def test_micro_batch_reads_touched_prefixes_only(spark, tmp_path):
    """The rows read for a batch of one prompt stay at those of its prefix, however long the history."""
    results, read, own = str(tmp_path / "out"), [], hashlib.md5(b"0").hexdigest()[:2]
    for step in range(3):
        history = spark.range(step * 300, step * 300 + 300).select(F.md5(F.col("id").cast("string").cast("binary")).alias("prompt_digest"))
        rows = history.select("prompt_digest", *[F.lit(v).cast(k).alias(c) for c, k, v in (
            ("model", "string", "good"), ("response", "string", "{}"), ("input_tokens", "double", 1), ("output_tokens", "double", 1),
            ("cached_input_tokens", "double", None), ("cost", "double", None), ("error", "string", None))])
        rows = rows.withColumn("prefix", F.left("prompt_digest", F.lit(2))).withColumn("batch", F.lit(step))
        rows.repartition("prefix").write.mode("append").partitionBy("prefix", "batch").parquet(f"{results}/parts")
        done = incremental.earlier_answers(spark, results, [own, "zz"], 99)
        read.append(done.count())
        assert {r[0][:2] for r in done.collect()} == {own}
    assert spark.read.parquet(f"{results}/parts").count() == 900 and read[-1] < 15
    assert incremental.earlier_answers(spark, results, ["zz"], 99) is None
    assert incremental.earlier_answers(spark, results, [own], 2).count() == read[1]  # a replayed batch does not see itself


def test_text_is_shuffled_once_for_all_raters(spark):
    nine = [dict(RATERS[0], model=f"m{i}", prompt_batch_size=i + 1) for i in range(9)]
    sizes = spark.sparkContext.accumulator(0)

    def watched(prompts, model, params):
        assert len(prompts) <= int(model[1:]) + 1
        sizes.add(1)
        return scorer(prompts, "good", params)

    plans = []
    import annolytics.operators.annotate as module
    kept = module.materialize
    try:
        module.materialize = lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, label))[1]
        out = annotate.score(prompted(spark, 40), nine, watched)
    finally:
        module.materialize = kept
    assert plans[0].count("Exchange ") == 1 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").replace("Exchange SinglePartition", "").replace("Exchange hashpartitioning(_slice", "")
    rows = out.collect()
    assert len(rows) == 360 and len({(r.prompt_digest, r.model) for r in rows}) == 360 and not any(r.error for r in rows)
    assert sizes.value < 360  # batches, not single prompts


def test_session_helpers(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    few = spark.range(9).withColumn("t", F.repeat(F.lit("x"), 100))
    assert "broadcast" in broadcast_if_small(few)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_if_small(few, max_bytes=500)._jdf.queryExecution().toString().lower()
    small, big = spark.range(5), spark.range(50)
    assert "hint" in broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(big, 10)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("parts", [0, 3])
def test_streamed_plans_read_files_and_folders(spark, tmp_path, parts):
    """A table is one file, or a folder of part files as Spark writes it."""
    from annolytics.plans.all import PLANS

    for name in ("documents", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        target = tmp_path / f"{name}.parquet"
        if parts:
            rows.repartition(parts).write.parquet(str(target))
        else:
            shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", target)
    for plan in ("z1_incremental_rollup", "z2_incremental_annotation"):
        got = PLANS[plan](spark, str(tmp_path)).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, PLANS[plan](spark, "/root/testdata/sf0.001").collect())) and got
