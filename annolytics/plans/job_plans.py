"""Annotation jobs, configuration, release tables, sinks and incremental runs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators import annotate, publish, relational
from annolytics.plans.preludes import clean, sql
from annolytics.plans.registry import plan
from annolytics.plans.text_plans import TEMPLATE, TEMPLATE_SQL
from annolytics.session import materialize, new_path
from annolytics.sources import sinks, tables
from annolytics.sources.standins import CATEGORIES, RATER_CUTS, Tables
from annolytics.streaming import incremental

RATER_CONFIG = {
    "rules": {
        "chat_function": "rule", "prompt_batch_size": 50, "params": {"per": "100"},
        "models": [
            {"name": name, "params": {"cut": str(cut)}, **({"prompt_batch_size": 20} if k > 6 else {})}
            for name, k, cut in RATER_CUTS
        ],
    },
    "spare": {"chat_function": "rule", "models": [{"name": "unused", "enabled": False}, {"name": ""}]},
}
EVENT_CONFIG = {
    "web": {
        "chat_function": "chat_openai", "processing": "batch", "prompt_batch_size": 500, "params": {"seed": 1},
        "models": ["view", {"name": "click", "processing": "parallel", "params": {"seed": 2}}, {"model": "signup"}],
    },
    "shop": {"chat_function": "chat_other", "models": [{"name": "purchase"}, {"name": "error", "enabled": False}]},
}


def rule_scorer(prompts: Sequence[str], model: str, params: Mapping[str, str]) -> list[dict]:
    """Deterministic stand-in for a chat service: says yes above a density of "th"; rater_9 is out of order."""
    if model == "rater_9":
        raise RuntimeError("out of order")
    out = []
    for prompt in prompts:
        hits = prompt.lower().count("th")
        about = float(params["per"]) * hits / len(prompt) > float(params["cut"])
        answer = {"about_politics": about, "justification": f"{hits} hits", "confidence_score": min(hits, 100) / 100}
        out.append({"response": json.dumps(answer), "input_tokens": len(prompt), "output_tokens": 3})
    return out


def _slots() -> dict:
    return {"source": F.col("source"), "lang": F.col("lang"), "year": F.col("year"), "body": F.col("text")}


def prompted(t: Tables) -> DataFrame:
    return annotate.prompts(t.docs(), TEMPLATE, _slots())


def work(t: Tables, exclude: Sequence[str] = ()) -> DataFrame:
    return annotate.work_list(prompted(t), tables.raters_from_config(RATER_CONFIG), exclude)


_PROMPTS_SQL = f"prompts AS (SELECT DISTINCT md5({TEMPLATE_SQL}) AS prompt_digest, {TEMPLATE_SQL} AS prompt FROM docs)"
_SCORED_SQL = f"""{_PROMPTS_SQL},
    counted AS (SELECT prompt_digest, CAST(length(prompt) AS DOUBLE) AS len,
                       (length(lower(prompt)) - length(replace(lower(prompt), 'th', ''))) // 2 AS hits FROM prompts)"""


@plan("s4_rater_dimension", "S4 J1", """
    SELECT api, model, processing, prompt_batch_size, seed, count(event_id) AS responses FROM (VALUES
        ('web', 'view', 'batch', 500, '1'), ('web', 'click', 'parallel', 500, '2'), ('web', 'signup', 'batch', 500, '1'),
        ('shop', 'purchase', 'sequential', 5, NULL)) AS r(api, model, processing, prompt_batch_size, seed)
    LEFT JOIN events ON event_type = model GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    raters = tables.rater_dimension(t.spark, EVENT_CONFIG)
    counts = t.raw("events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("responses"))
    joined = raters.join(counts, "model", "left")
    return joined.select(
        "api", "model", "processing", "prompt_batch_size", F.try_element_at("params", F.lit("seed")).alias("seed"),
        F.coalesce("responses", F.lit(0)).alias("responses"),
    )


@plan("b6_work_list", "B6 J5 W2 T8 T9", sql("docs rules", f"""
    WITH {_PROMPTS_SQL} SELECT prompt_digest, rater AS model, CAST((row_number() OVER (PARTITION BY rater ORDER BY prompt_digest) - 1)
           // CASE WHEN k > 6 THEN 20 ELSE 50 END + 1 AS BIGINT) AS batch FROM prompts CROSS JOIN rules"""))
def _(t: Tables) -> DataFrame:
    return work(t).select("prompt_digest", "model", "batch")


@plan("b1_annotation_job", "B1 B2 B3 B4 B7 N10", sql("docs rules", f"""
    WITH {_SCORED_SQL} SELECT prompt_digest, rater AS model, CASE WHEN k < 9 THEN 1e2 * hits / len > cut END AS about_politics,
           CASE WHEN k < 9 THEN least(hits, 100) / 1e2 END AS confidence_score, CASE WHEN k < 9 THEN len END AS input_tokens,
           CASE WHEN k < 9 THEN 3e0 END AS output_tokens, CASE WHEN k = 9 THEN 'RuntimeError: out of order' END AS error
    FROM counted CROSS JOIN rules"""))
def _(t: Tables) -> DataFrame:
    scored = annotate.parse_flag(annotate.with_token_columns(
        annotate.score(prompted(t), tables.raters_from_config(RATER_CONFIG), rule_scorer)))
    return scored.select("prompt_digest", "model", "about_politics", "confidence_score", "input_tokens", "output_tokens", "error")


@plan("b5_task_without_a_rater", "B5", sql("docs rules", f"""
    WITH {_PROMPTS_SQL} SELECT rater AS model, count(*) AS prompts FROM prompts CROSS JOIN rules WHERE k < 8 GROUP BY rater"""))
def _(t: Tables) -> DataFrame:
    return work(t, exclude=["rater_8", "rater_9"]).groupBy("model").agg(F.count(F.lit(1)).alias("prompts"))


@plan("j11_resumed_job", "J11 B7 Z2", sql("docs rules", f"""
    WITH {_SCORED_SQL} SELECT prompt_digest, rater AS model, CASE WHEN k < 9 THEN 1e2 * hits / len > cut END AS about_politics FROM counted CROSS JOIN rules"""))
def _(t: Tables) -> DataFrame:
    raters = tables.raters_from_config(RATER_CONFIG)
    others = [r["model"] for r in raters if r["model"] != "rater_1"]
    done = materialize(annotate.score(prompted(t), raters, rule_scorer, exclude=others), "done")  # scored once
    rest = annotate.score(prompted(t), raters, rule_scorer, done)
    return annotate.parse_flag(annotate.combine([done, rest])).select("prompt_digest", "model", "about_politics")


@plan("b3_theme_answers", "B3 N10", sql("theme_pairs theme_rows", """
    SELECT p.doc_id, p.rater, CAST(count(r.theme) AS INTEGER) AS n, count(r.theme) = 0 AS invalid
    FROM theme_pairs p LEFT JOIN theme_rows r ON p.doc_id = r.doc_id AND p.rater = r.rater GROUP BY p.doc_id, p.rater"""))
def _(t: Tables) -> DataFrame:
    answers = t.themes().select("doc_id", "rater", F.to_json(F.struct("themes")).alias("response"))
    parsed = annotate.parse_themes(answers, CATEGORIES)
    return parsed.select("doc_id", "rater", F.size("themes").alias("n"), "invalid")


@plan("b4_token_columns", "B4", """
    SELECT event_id, value AS input_tokens, CAST(NULL AS DOUBLE) AS output_tokens, CAST(NULL AS DOUBLE) AS cached_input_tokens,
           CAST(NULL AS DOUBLE) AS cost FROM events""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_id", F.col("value").alias("input_tokens"), F.col("event_type").alias("cost"))
    return annotate.with_token_columns(rows).select("event_id", *annotate.TOKEN_COLUMNS)


@plan("s1_csv_scan", "S1 S2", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    path = sinks.write_csv(rows, new_path(t.spark, "customer"))
    return tables.read_csv(t.spark, path, rows.schema)


@plan("s7_paired_sink", "S7 S8 S9", "SELECT conv_id, turn, role, text FROM conversations")
def _(t: Tables) -> DataFrame:
    rows = t.raw("conversations")
    paths = sinks.write_pair(rows, new_path(t.spark, "conversations"))
    stored = t.spark.read.schema(rows.schema).parquet(paths["parquet"])
    text_form = tables.read_csv(
        t.spark, paths["csv"], "conv_id long, turn long, role string, text string", line_breaks_in_fields=True
    )
    return stored.join(text_form.select("conv_id", "turn", F.col("text").alias("_t")), ["conv_id", "turn"]).where(
        F.col("_t") == F.col("text")
    ).drop("_t")


ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)


def _columns_sql(name: str) -> str:
    return f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {name}))"


@plan("s11_snapshot_manifest", "S11", " UNION ALL ".join(
    f"SELECT '{name}' AS target, count(*) AS rows, {_columns_sql(name)} AS columns, true AS has_bytes, 32 AS hash_digits, {name == 'documents'} AS sensitive FROM {name}"
    for name in ALL_TABLES))
def _(t: Tables) -> DataFrame:
    manifest = publish.snapshot_manifest({name: t.raw(name) for name in ALL_TABLES}, sensitive=["documents"])
    return manifest.select(
        "target", "rows", "columns", (F.col("bytes") > 0).alias("has_bytes"), F.length("content_hash").alias("hash_digits"), "sensitive"
    )


@plan("s10_published_manifest", "S10", """
    SELECT 'labels' AS target, (SELECT count(*) FROM labels) AS rows, 32 AS hash_digits, 'Two coders per document' AS description UNION ALL
    SELECT 'nation', (SELECT count(*) FROM nation), 32, NULL""")
def _(t: Tables) -> DataFrame:
    manifest = publish.snapshot_manifest({name: t.raw(name) for name in ("labels", "nation")})
    notes = t.spark.createDataFrame([("labels", "Two coders per document"), ("other", "-")], "target string, description string")
    hashed = F.length("content_hash").alias("hash_digits")
    return publish.published_manifest(manifest, notes).select("target", "rows", hashed, "description")


@plan("s3_s8_list_files", "S3 S8 S2", """
    SELECT source, count(*) AS documents FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) % 2 = 0)
    GROUP BY source""")
def _(t: Tables) -> DataFrame:
    """The list of sources with an even number of documents goes out as one file and comes back as a list of known items."""
    counts = t.docs().groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0 and source is not null")
    path = sinks.write_csv(counts.select(F.col("source").alias("Known Source")), new_path(t.spark, "list"), single_file=True)
    listed = tables.reference_list(t.spark, path, "known_source").withColumnRenamed("known_source", "source")
    return relational.keep_keys(t.docs(), listed, ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@plan("s1_chart_scan", "S1 S2 P11", """
    SELECT CAST(l_shipdate AS DATE) AS date, 's' || l_partkey AS song, 'a' || l_suppkey AS artist, CAST(l_linenumber AS INTEGER) AS rank,
           CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_linenumber AS INTEGER) END AS weeks_in_charts,
           CASE WHEN l_linenumber % 2 = 0 THEN 'http://' || l_orderkey END AS image_url FROM lineitem""")
def _(t: Tables) -> DataFrame:
    """Chart weeks written with dashes and hash marks for what is missing, as charts come, and scanned again."""
    rows = t.raw("lineitem")
    line = F.col("l_linenumber")
    weeks = rows.select(
        F.col("l_shipdate").cast("date").alias("Date"), F.concat(F.lit("s"), "l_partkey").alias("Song"), F.concat(F.lit("a"), "l_suppkey").alias("Artist"),
        line.alias("Rank"), line.alias("Last Week"), line.alias("Peak Position"), F.when(line % 3 > 0, line.cast("string")).otherwise("-").alias("Weeks in Charts"),
        F.when(line % 2 == 0, F.concat(F.lit("http://"), "l_orderkey")).otherwise("#").alias("Image URL"),
    )
    chart = tables.read_chart(t.spark, sinks.write_csv(weeks, new_path(t.spark, "chart")))
    return chart.select("date", "song", "artist", "rank", "weeks_in_charts", "image_url")


@plan("u1_u2_pseudonymised_codes", "U1 U2 W10 J10", sql("human", """
    SELECT doc_id, year, 'Coder ' || CASE coder WHEN 'coder_a' THEN 'A' ELSE 'B' END AS coder, is_political, confidence FROM human"""))
def _(t: Tables) -> DataFrame:
    named = t.human().withColumnRenamed("coder", "coder_name").withColumn("note", F.lit("private"))
    return publish.pseudonymise(named, "coder_name", ["note", "url"]).orderBy("doc_id", "coder")


@plan("u3_text_features", "U3 U1 T4", sql("docs", f"""
    SELECT doc_id, year, coalesce(text, '') <> '' AS has_text,
           {', '.join(f"regexp_matches({clean('text')}, '{p}') AS keyword_{k}" for k, p in text.KEYWORD_PATTERNS.items())} FROM docs"""))
def _(t: Tables) -> DataFrame:
    return publish.text_features(t.docs(), "text", ["doc_id", "year"])


@plan("u4_sorted_dimension", "U4 W7", """
    SELECT n_name AS category, r_name AS description, count(s_suppkey) AS uses FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name ORDER BY category""")
def _(t: Tables) -> DataFrame:
    nation = t.raw("nation").join(t.raw("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    uses = t.raw("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("uses"))
    joined = nation.join(uses, "n_nationkey", "left").select(
        F.col("n_name").alias("category"), F.col("r_name").alias("description"), F.coalesce("uses", F.lit(0)).alias("uses")
    )
    return joined.orderBy("category")


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream; the braces make its path a pattern, which may be one file or a folder of parts."""
    return t.spark.readStream.schema(t.raw(name).schema).parquet(f"{t.folder}/{{{name}}}.parquet")


@plan("z1_incremental_rollup", "Z1 A1", sql("chart", """
    SELECT song, artist, count(*) AS weeks, min(rank) AS top, CAST(max(yr) FILTER (WHERE rank = best) AS INTEGER) AS year
    FROM (SELECT *, year(date) AS yr, min(rank) OVER (PARTITION BY song, artist) AS best FROM chart) GROUP BY song, artist"""))
def _(t: Tables) -> DataFrame:
    source = _stream(t, "lineitem").select(
        F.col("l_partkey").alias("song"), F.col("l_suppkey").alias("artist"), F.col("l_linenumber").alias("rank"),
        F.col("l_shipdate").alias("date"),
    )
    state = new_path(t.spark, "rollup")
    incremental.stream_rollup(source, state, ["song", "artist"], "rank", "date")
    return incremental.read_rollup(t.spark, state, ["song", "artist"])


@plan("z2_incremental_annotation", "Z2 B1", sql("docs rules", f"""
    WITH {_SCORED_SQL} SELECT prompt_digest, rater AS model, CASE WHEN k < 9 THEN 1e2 * hits / len > cut END AS about_politics FROM counted CROSS JOIN rules"""))
def _(t: Tables) -> DataFrame:
    docs = _stream(t, "documents").withColumn("year", (1958 + F.col("doc_id") % 68).cast("int"))
    results = new_path(t.spark, "annotations")
    source = annotate.prompts(docs, TEMPLATE, _slots()).select("prompt_digest", "prompt")
    incremental.stream_annotation(source, results, tables.raters_from_config(RATER_CONFIG), rule_scorer)
    stored = incremental.read_annotations(t.spark, results)
    return annotate.parse_flag(stored).select("prompt_digest", "model", "about_politics")


@plan("s6_labelled_scan", "S6", sql("human", "SELECT doc_id, coder, is_political FROM human WHERE coder = 'coder_a'"))
def _(t: Tables) -> DataFrame:
    return tables.coded_rows(t.human(), ["coder_a"], "coder").select("doc_id", "coder", "is_political")


