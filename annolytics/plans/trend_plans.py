"""Densities, trends and lexicon scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators import aggregate, dedupe, lexicon, relational, reshape, trend, windows
from annolytics.plans.agreement_plans import KNOWN_SQL, known_items
from annolytics.plans.preludes import sql, words
from annolytics.plans.registry import plan
from annolytics.sources.standins import MEASURES, Tables


def density_sql(rows: str, by: str = "", shared: str | None = None) -> str:
    """Density of ``rows(by, x)`` on the grid 1958..2025; ``shared`` averages the widths within that column."""
    group, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    over = f"PARTITION BY {shared}" if shared else ""
    h = f"avg(h0) OVER ({over})" if shared is not None else "h0"
    return f"""
    r AS ({rows}),
    w AS (SELECT {group}count(*) AS total, stddev_samp(x) AS sd,
                 (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34e0 AS iq, abs(min(x)) AS ax FROM r {'GROUP BY ' + by if by else ''}),
    b0 AS (SELECT {group}total, 9e-1 * CASE WHEN least(coalesce(sd, 0), iq) > 0 THEN least(sd, iq) WHEN sd > 0 THEN sd
                 ELSE coalesce(nullif(ax, 0), 1) END * pow(CAST(total AS DOUBLE), -2e-1) AS h0 FROM w),
    b AS (SELECT *, {h} AS h FROM b0),
    c AS (SELECT {group}x, count(*) AS n FROM r GROUP BY {group}x)
    SELECT {group}CAST(g AS DOUBLE) AS grid, round(sum(n * exp(-5e-1 * pow((g - x) / h, 2))) / (max(total) * max(h) * sqrt(2 * pi())), 7) AS density
    FROM c JOIN b {using} CROSS JOIN range(1958, 2026) AS t(g) GROUP BY {group}g"""


def _density_out(df: DataFrame) -> DataFrame:
    return df.withColumn("density", F.round("density", 7))


@plan("y1_density_of_items", "Y1 A8", sql("ratings", "WITH " + density_sql("""
    SELECT CAST(year AS DOUBLE) AS x FROM ratings GROUP BY doc_id, year
    HAVING round(sum(CAST(about AS DOUBLE) * confidence) / sum(CASE WHEN about IS NOT NULL THEN confidence END), 9) > 8e-1""").strip()))
def _(t: Tables) -> DataFrame:
    scored = aggregate.weighted_rates(t.ratings(), ["doc_id", "year"], "about", "confidence").where(F.round("share", 9) > 0.8)
    return _density_out(trend.kernel_density(scored, "year", 1958.0, 2025.0, 68))


@plan("y2_density_per_theme", "Y2", sql("theme_rows", "WITH " + density_sql(
    "SELECT theme, CAST(year AS DOUBLE) AS x FROM theme_rows", "theme").strip()))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return _density_out(trend.kernel_density(rows, "year", 1958.0, 2025.0, 68, ["theme"]))


@plan("y2_density_per_theme_and_rater", "Y2", sql("theme_rows", "WITH " + density_sql(
    "SELECT theme, rater, CAST(year AS DOUBLE) AS x FROM theme_rows", "theme, rater", "rater").strip()))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    out = trend.kernel_density(rows, "year", 1958.0, 2025.0, 68, ["theme", "rater"], ["rater"])
    return _density_out(out)


@plan("y2_density_shared_width", "Y2", sql("theme_rows", "WITH " + density_sql(
    "SELECT theme, CAST(year AS DOUBLE) AS x FROM theme_rows", "theme", "").strip()))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return _density_out(trend.kernel_density(rows, "year", 1958.0, 2025.0, 68, ["theme"], []))


@plan("y3_linear_trend", "Y3", sql("ratings", """
    SELECT rater, CAST(regr_count(confidence, CAST(year AS DOUBLE)) AS BIGINT) AS n,
           round(regr_slope(confidence, CAST(year AS DOUBLE)), 8) AS slope,
           round(regr_intercept(confidence, CAST(year AS DOUBLE)), 6) AS intercept,
           round(regr_r2(confidence, CAST(year AS DOUBLE)), 8) AS r2 FROM ratings GROUP BY rater"""))
def _(t: Tables) -> DataFrame:
    out = trend.linear_trend(t.ratings().withColumn("year", F.col("year").cast("double")), ["rater"], "year", "confidence")
    return out.select("rater", "n", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 8).alias("r2"))


@plan("y3_binned_trend", "Y3", sql("ratings", """
    SELECT rater, CAST(floor(year / 10) AS BIGINT) AS bin, count(confidence) AS n, round(avg(confidence), 9) AS mean,
           round(stddev_samp(confidence) / sqrt(count(confidence)), 9) AS se FROM ratings GROUP BY 1, 2"""))
def _(t: Tables) -> DataFrame:
    out = trend.binned_trend(t.ratings(), ["rater"], "year", "confidence", 10)
    return out.select("rater", "bin", "n", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@plan("y4_popularity", "Y4 F6", sql("docs ratings", """
    SELECT year, majority, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS median,
           round(avg(log10(n_chars)), 8) AS mean_log10
    FROM docs JOIN (SELECT doc_id, count(*) FILTER (WHERE about) > 4.5 AS majority FROM ratings GROUP BY doc_id) USING (doc_id)
    GROUP BY year, majority"""))
def _(t: Tables) -> DataFrame:
    majority = t.ratings().groupBy("doc_id").agg((F.count_if("about") > 4.5).alias("majority"))
    out = trend.popularity(t.docs().join(majority, "doc_id"), ["year", "majority"], "n_chars")
    return out.select(
        "year", "majority", "n", F.round("mean", 6).alias("mean"), "median", F.round("mean_log10", 8).alias("mean_log10")
    )


_HITS = f"""
    w AS (SELECT doc_id, {words('text')} AS w FROM docs),
    runs AS (SELECT doc_id, len(w) AS tokens, unnest(w) AS term FROM w
             UNION ALL SELECT doc_id, len(w), unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
    hits AS (SELECT doc_id, category, count(*) AS hits, count(*) / CAST(max(tokens) AS DOUBLE) AS score
             FROM runs JOIN (SELECT DISTINCT category, term FROM lexicon) USING (term) GROUP BY doc_id, category)"""
_WIDE = ", ".join(f"round(coalesce(max(score) FILTER (WHERE category = '{m}'), 0), 9) AS {m}" for m in MEASURES)


def scored(t: Tables) -> DataFrame:
    scores = lexicon.category_scores(t.docs(), "doc_id", "text", t.lexicon(), longest=2)
    wide = lexicon.scores_wide(t.docs().select("doc_id", "year"), "doc_id", scores, MEASURES)
    return wide.withColumns({m: F.round(m, 9) for m in MEASURES})


@plan("x1_lexicon_scores", "X1 N1", sql("docs lexicon", f"""
    WITH {_HITS.strip()} SELECT d.doc_id, d.year, {_WIDE} FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id, d.year"""))
def _(t: Tables) -> DataFrame:
    return scored(t)


@plan("x2_seed_expansion", "X2", """
    WITH seeds AS (SELECT label, min(vec_id) AS seed_id FROM embeddings GROUP BY label),
    sim AS (SELECT s.label, s.seed_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS cosine
            FROM seeds s JOIN embeddings e ON e.vec_id = s.seed_id JOIN embeddings v ON v.vec_id <> s.seed_id)
    SELECT label, seed_id, vec_id, round(cosine, 7) AS cosine, CAST(row_number() OVER (PARTITION BY label, seed_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank
    FROM sim QUALIFY rank <= 5""")
def _(t: Tables) -> DataFrame:
    vectors = t.raw("embeddings")
    seeds = dedupe.first_per_key(vectors.select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    near = lexicon.nearest_to_seeds(vectors, "vec_id", "embedding", seeds, "label", 5)
    return near.withColumn("cosine", F.round("cosine", 7))


@plan("x3_phrase_hits", "X3", sql("docs lexicon", f"""
    WITH {_HITS.strip()} SELECT term, category, count(*) AS n, count(DISTINCT doc_id) AS docs
    FROM runs JOIN (SELECT DISTINCT category, term FROM lexicon WHERE term LIKE '% %') USING (term) GROUP BY term, category"""))
def _(t: Tables) -> DataFrame:
    phrases = t.lexicon().where(F.col("term").contains(" ")).distinct()
    hits = relational.lookup(lexicon.phrase_hits(t.docs(), "doc_id", "text", phrases, 2), phrases, "term", "inner")
    return hits.groupBy("term", "category").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@plan("x3_unreachable_seeds", "X3", sql("docs lexicon", f"""
    WITH {_HITS.strip()} SELECT l.category, l.term, l.term LIKE '%''%' AS unreachable, count(r.doc_id) AS n
    FROM (SELECT DISTINCT * FROM lexicon) l LEFT JOIN runs r ON r.term = l.term GROUP BY l.category, l.term"""))
def _(t: Tables) -> DataFrame:
    terms = t.lexicon().distinct()
    bad = lexicon.unreachable_seeds(terms, 2).withColumn("unreachable", F.lit(True))
    counts = lexicon.phrase_hits(t.docs(), "doc_id", "text", terms, 2).groupBy("term").agg(F.sum("n").alias("n"))
    joined = terms.join(bad, ["category", "term"], "left").join(counts, "term", "left")
    return joined.select(
        "category", "term", F.coalesce("unreachable", F.lit(False)).alias("unreachable"), F.coalesce("n", F.lit(0)).alias("n")
    )


@plan("x4_topic_names", "X4", sql("docs lexicon", f"""
    WITH {_HITS.strip()} SELECT t.category AS topic, count(h.doc_id) AS docs
    FROM (SELECT DISTINCT category FROM lexicon) t LEFT JOIN hits h USING (category) GROUP BY t.category"""))
def _(t: Tables) -> DataFrame:
    scores = lexicon.category_scores(t.docs(), "doc_id", "text", t.lexicon(), 2).withColumnRenamed("category", "topic")
    joined = relational.join_on(lexicon.topics_of(t.lexicon()), scores, ["topic"], "left")
    return joined.groupBy("topic").agg(F.count("doc_id").alias("docs"))


@plan("x5_any_signal", "X5 P5", sql("docs lexicon", f"""
    WITH {_HITS.strip()}, wide AS (SELECT d.doc_id, {_WIDE} FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT doc_id, law, military FROM wide WHERE law > 0 OR military > 0 OR terrorism > 0"""))
def _(t: Tables) -> DataFrame:
    return lexicon.any_signal(scored(t), ["law", "military", "terrorism"]).select("doc_id", "law", "military")


@plan("x6_known_item_scores", "X6 J6 D4 P9", sql("docs lexicon", f"""
    WITH {_HITS.strip()}, {KNOWN_SQL.strip()},
    wide AS (SELECT d.doc_id, {_WIDE} FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id),
    best AS (SELECT source, title_key, {', '.join(f'max({m}) AS {m}' for m in MEASURES)} FROM keyed JOIN wide USING (doc_id) GROUP BY ALL)
    SELECT k.source, k.title, k.title_key, {', '.join(f'round(coalesce(b.{m}, 0), 3) AS {m}' for m in MEASURES)}
    FROM known k LEFT JOIN best b ON k.source = b.source AND k.title_key = b.title_key"""))
def _(t: Tables) -> DataFrame:
    keyed = t.headings().join(t.docs().select("doc_id", "source"), "doc_id")
    keyed = keyed.select("source", text.join_key(F.col("title")).alias("title_key"), "doc_id")
    best = aggregate.max_per_entity(keyed.join(scored(t), "doc_id"), ["source", "title_key"], MEASURES)
    return lexicon.known_item_scores(known_items(t), best, ["source", "title_key"], MEASURES)


@plan("x7_positive_documents_per_year", "X7 A12", sql("docs lexicon", f"""
    WITH {_HITS.strip()} SELECT year, category AS measure, count(*) AS n FROM hits JOIN docs USING (doc_id)
    WHERE category IN ({', '.join(f"'{m}'" for m in MEASURES)}) GROUP BY year, category"""))
def _(t: Tables) -> DataFrame:
    return aggregate.positive_counts_long(scored(t), ["year"], MEASURES)


@plan("x7_top_six_per_measure", "X7 W5", sql("docs lexicon", f"""
    WITH {_HITS.strip()} SELECT category AS measure, doc_id, round(round(score, 9), 3) AS score,
           CAST(row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank
    FROM hits WHERE category IN ({', '.join(f"'{m}'" for m in MEASURES)}) QUALIFY rank <= 6"""))
def _(t: Tables) -> DataFrame:
    long = reshape.long(scored(t), ["doc_id"], MEASURES, "measure", "score").where("score > 0")
    top = windows.top_per_group(long, ["measure"], [F.desc("score"), F.asc("doc_id")], 6)
    return top.select("measure", "doc_id", F.round("score", 3).alias("score"), "rank")
