"""Chart rollups, entity rates, contingency tables and cost accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators import aggregate, relational, reshape
from annolytics.plans.preludes import clean, sql
from annolytics.plans.registry import plan
from annolytics.session import spread
from annolytics.sources.standins import RATERS, Tables


@plan("a1_entity_rollup", "A1 F1", sql("chart", """
    SELECT song, artist, CAST(sum(1) AS BIGINT) AS weeks, min(rank) AS top,
           CAST(max(yr) FILTER (WHERE rank = best) AS INTEGER) AS year
    FROM (SELECT *, year(date) AS yr, min(rank) OVER (PARTITION BY song, artist) AS best FROM chart)
    GROUP BY song, artist"""))
def _(t: Tables) -> DataFrame:
    return aggregate.entity_rollup(t.chart(), ["song", "artist"], "rank", "date")


@plan("a2_item_summary", "A2 D1 P12", sql("ratings", """
    SELECT doc_id, round(avg(CAST(about AS DOUBLE)), 9) AS share, round(avg(confidence), 9) AS confidence,
           CAST(coalesce(sum(CAST(about AS INTEGER)), 0) AS BIGINT) AS votes
    FROM ratings GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    out = aggregate.item_summary(t.ratings(), ["doc_id"], "about", "confidence")
    return out.withColumns({"share": F.round("share", 9), "confidence": F.round("confidence", 9)})


@plan("a3_majority_items", "A3", sql("ratings", """
    SELECT doc_id, CAST(sum(CAST(about AS INTEGER)) AS BIGINT) AS votes FROM ratings
    GROUP BY doc_id HAVING sum(CAST(about AS INTEGER)) > 4.5"""))
def _(t: Tables) -> DataFrame:
    summary = aggregate.item_summary(t.ratings(), ["doc_id"], "about", "confidence")
    return aggregate.majority(summary, len(RATERS)).select("doc_id", "votes")


@plan("a4_rate_per_rater", "A4", sql("ratings", """
    SELECT rater, CAST(sum(CAST(about AS INTEGER)) AS BIGINT) AS positives,
           round(avg(CAST(about AS DOUBLE)), 9) AS share FROM ratings GROUP BY rater"""))
def _(t: Tables) -> DataFrame:
    return aggregate.rates(t.ratings(), ["rater"], "about").withColumn("share", F.round("share", 9))


@plan("a5_rate_range", "A5", sql("ratings", """
    SELECT round(min(s), 9) AS low, round(max(s), 9) AS high
    FROM (SELECT avg(CAST(about AS DOUBLE)) AS s FROM ratings GROUP BY rater)"""))
def _(t: Tables) -> DataFrame:
    out = aggregate.rate_range(t.ratings(), "rater", "about")
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@plan("a6_rate_per_year_and_rater", "A6", sql("ratings", """
    SELECT year, rater, CAST(coalesce(sum(CAST(about AS INTEGER)), 0) AS BIGINT) AS positives,
           round(avg(CAST(about AS DOUBLE)), 9) AS share FROM ratings GROUP BY year, rater"""))
def _(t: Tables) -> DataFrame:
    return aggregate.rates(t.ratings(), ["year", "rater"], "about").withColumn("share", F.round("share", 9))


@plan("a7_mean_and_error_per_year", "A7", sql("ratings", """
    SELECT year, round(avg(s), 9) AS mean, round(stddev_samp(s) / sqrt(count(s)), 9) AS se, count(s) AS n
    FROM (SELECT year, rater, avg(CAST(about AS DOUBLE)) AS s FROM ratings GROUP BY year, rater) GROUP BY year"""))
def _(t: Tables) -> DataFrame:
    per_rater = aggregate.rates(t.ratings(), ["year", "rater"], "about")
    out = aggregate.mean_se(per_rater, ["year"], "share")
    return out.select("year", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"), "n")


@plan("a8_weighted_rate_per_year", "A8", sql("ratings", """
    SELECT year, rater, round(sum(CAST(about AS DOUBLE) * confidence) /
                              sum(CASE WHEN about IS NOT NULL THEN confidence END), 9) AS share
    FROM ratings GROUP BY year, rater"""))
def _(t: Tables) -> DataFrame:
    out = aggregate.weighted_rates(t.ratings(), ["year", "rater"], "about", "confidence")
    return out.withColumn("share", F.round("share", 9))


@plan("a8_weighted_rate_per_item", "A8", sql("ratings", """
    SELECT doc_id, round(sum(CAST(about AS DOUBLE) * confidence) /
                         sum(CASE WHEN about IS NOT NULL THEN confidence END), 9) AS share
    FROM ratings GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    out = aggregate.weighted_rates(t.ratings(), ["doc_id"], "about", "confidence")
    return out.withColumn("share", F.round("share", 9))


@plan("a9_confidence_per_label", "A9", sql("ratings", """
    SELECT rater, about, round(avg(confidence), 9) AS confidence FROM ratings GROUP BY rater, about"""))
def _(t: Tables) -> DataFrame:
    return t.ratings().groupBy("rater", "about").agg(F.round(F.avg("confidence"), 9).alias("confidence"))


@plan("a10_missing_text_rate", "A10 P6", sql("docs", """
    SELECT year, round(avg(CASE WHEN quality IS NULL THEN 1e0 ELSE 0e0 END), 9) AS missing_label,
           round(avg(CASE WHEN coalesce(text, '') = '' THEN 1e0 ELSE 0e0 END), 9) AS missing_text
    FROM docs LEFT JOIN labels USING (doc_id) GROUP BY year"""))
def _(t: Tables) -> DataFrame:
    joined = relational.lookup(t.docs(), t.raw("labels"), "doc_id")
    return joined.groupBy("year").agg(
        F.round(F.avg(F.col("quality").isNull().cast("double")), 9).alias("missing_label"),
        F.round(F.avg((~text.has_text(F.col("text"))).cast("double")), 9).alias("missing_text"),
    )


FLAG_PATTERNS = {
    "the": "(^| )the( |$)", "ed": "(^| )(ed|edly)( |$)", "ungen": "ung", "que": "(^| )que(s)?( |$)", "la": "(^| )la( |$)",
    "an": "(^| )an", "politics": "(^| )politic(s|al)( |$)", "war": "(^| )war(s)?( |$)",
}
_FLAGS_SQL = ", ".join(f"regexp_matches(c, '{p}') AS keyword_{k}" for k, p in FLAG_PATTERNS.items())


@plan("a11_keyword_rate_per_year", "A11 T4 N3", sql("docs", f"""
    WITH flags AS (SELECT year, {_FLAGS_SQL} FROM (SELECT year, {clean('text')} AS c FROM docs)),
    rates AS (SELECT year, {', '.join(f'avg(CAST(keyword_{k} AS DOUBLE)) AS keyword_{k}' for k in FLAG_PATTERNS)}
              FROM flags GROUP BY year)
    SELECT year, keyword, round(rate, 9) AS rate
    FROM (UNPIVOT rates ON {', '.join(f'keyword_{k}' for k in FLAG_PATTERNS)} INTO NAME keyword VALUE rate)"""))
def _(t: Tables) -> DataFrame:
    docs = spread(t.docs().select("doc_id", "year", "text"), "doc_id")
    flags = docs.select("year", text.clean_text(F.col("text")).alias("_c")).select(
        "year", *text.keyword_flags(F.col("_c"), FLAG_PATTERNS)
    )
    out = aggregate.flag_rates_long(flags, ["year"], [f"keyword_{k}" for k in FLAG_PATTERNS])
    return out.withColumn("rate", F.round("rate", 9))


@plan("a13_max_per_entity", "A13", sql("docs", """
    SELECT lang, source, max(n_chars) AS n_chars, max(quality) AS quality, max(toxic) AS toxic
    FROM docs LEFT JOIN labels USING (doc_id) GROUP BY lang, source"""))
def _(t: Tables) -> DataFrame:
    joined = relational.lookup(t.docs(), t.raw("labels"), "doc_id")
    return aggregate.max_per_entity(joined, ["lang", "source"], ["n_chars", "quality", "toxic"])


@plan("a14_contingency", "A14", sql("docs", """
    SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr,
           count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es
    FROM docs GROUP BY source"""))
def _(t: Tables) -> DataFrame:
    return aggregate.contingency(t.docs(), "source", "lang", {x: x for x in ("en", "fr", "de", "es")})


@plan("a15_coder_summary", "A15 S6 P11", sql("human", """
    SELECT coder, count(*) AS n, CAST(sum(is_political) AS BIGINT) AS positives,
           round(1e2 * avg(CAST(is_political AS DOUBLE)), 9) AS percent, round(avg(confidence), 9) AS confidence
    FROM human WHERE coder IN ('coder_a', 'coder_b') GROUP BY coder"""))
def _(t: Tables) -> DataFrame:
    from annolytics.sources.tables import coded_rows

    rows = coded_rows(t.human(), ["coder_a", "coder_b"], "coder")
    return rows.groupBy("coder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_political").alias("positives"),
        F.round(100.0 * F.avg(F.col("is_political").cast("double")), 9).alias("percent"),
        F.round(F.avg("confidence"), 9).alias("confidence"),
    )


@plan("a16_theme_frequency", "A16 N5", sql("theme_rows", """
    SELECT theme, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (), 9) AS percent
    FROM theme_rows GROUP BY theme"""))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return aggregate.label_frequency(rows, "theme").withColumn("percent", F.round("percent", 9))


@plan("a17_theme_share_per_rater", "A17", sql("theme_rows", """
    SELECT rater, theme, count(*) AS n,
           round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY rater) AS DOUBLE), 9) AS share
    FROM theme_rows GROUP BY rater, theme"""))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return aggregate.shares_within(rows, ["rater"], "theme").withColumn("share", F.round("share", 9))


@plan("a18_usage_totals", "A18", sql("usage", """
    SELECT model, processing, round(coalesce(sum(input_tokens), 0), 4) AS input_tokens,
           round(coalesce(sum(cached_input_tokens), 0), 4) AS cached_input_tokens,
           round(coalesce(sum(output_tokens), 0), 4) AS output_tokens, round(coalesce(sum(cost), 0), 6) AS cost
    FROM usage GROUP BY model, processing"""))
def _(t: Tables) -> DataFrame:
    out = aggregate.usage_totals(t.usage(), ["model", "processing"])
    tokens = {c: F.round(c, 4) for c in ("input_tokens", "cached_input_tokens", "output_tokens")}
    return out.withColumns({**tokens, "cost": F.round("cost", 6)})


_COST_SQL = """
    sums AS (SELECT model, processing, coalesce(sum(input_tokens), 0) AS ti, coalesce(sum(cached_input_tokens), 0) AS tc,
                    coalesce(sum(output_tokens), 0) AS tout, coalesce(sum(cost), 0) AS c FROM usage GROUP BY model, processing),
    priced AS (SELECT s.*, p.input_per_m AS pin, coalesce(p.batch_discount_factor, 1e0) AS disc,
                      (greatest(ti - tc, 0e0) * p.input_per_m + tc * coalesce(p.cached_input_per_m, p.input_per_m)
                       + tout * p.output_per_m) / 1e6 AS base,
                      (ti * p.input_per_m + tout * p.output_per_m) / 1e6 AS plain,
                      coalesce(p.cache_discounts_with_batch, TRUE) AS stack
               FROM sums s LEFT JOIN prices p USING (model)),
    costs AS (SELECT model, processing, ti, tc, tout,
                     CASE WHEN c = 0 AND pin IS NOT NULL THEN
                               CASE WHEN processing = 'batch' THEN (CASE WHEN stack THEN base ELSE plain END) * disc ELSE base END
                          WHEN processing = 'batch' THEN c / 2 ELSE c END AS cost FROM priced)"""


@plan("a19_estimated_costs", "A19 J1 S5", sql("usage prices", f"""
    WITH {_COST_SQL.strip()}
    SELECT model, processing, round(ti, 4) AS input_tokens, round(tc, 4) AS cached_input_tokens,
           round(tout, 4) AS output_tokens, round(cost, 6) AS cost FROM costs"""))
def _(t: Tables) -> DataFrame:
    out = aggregate.estimated_costs(t.usage(), t.prices())
    tokens = {c: F.round(c, 4) for c in ("input_tokens", "cached_input_tokens", "output_tokens")}
    return out.withColumns({**tokens, "cost": F.round("cost", 6)})


@plan("a20_cost_report", "A20", sql("usage prices", f"""
    WITH {_COST_SQL.strip()}
    SELECT model, processing, round(ti / 1e6, 6) AS input_tokens_m, round(cost, 6) AS cost,
           round(ti / 1e6, 6) AS input_tokens_m_second, round(cost, 6) AS cost_second FROM costs"""))
def _(t: Tables) -> DataFrame:
    costs = aggregate.estimated_costs(t.usage(), t.prices())
    columns = ("input_tokens_m", "cost", "input_tokens_m_second", "cost_second")
    return aggregate.cost_report(costs, costs).select("model", "processing", *[F.round(c, 6).alias(c) for c in columns])


@plan("a21_usage_averages", "A21", """
    SELECT event_type AS job, round(avg(value), 6) AS mean_seconds, round(sum(value), 4) AS seconds FROM events GROUP BY event_type""")
def _(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(F.col("event_type").alias("job")).agg(
        F.round(F.avg("value"), 6).alias("mean_seconds"), F.round(F.sum("value"), 4).alias("seconds")
    )


@plan("a21_token_averages", "A21", sql("usage", """
    WITH m AS (SELECT model, count(*) AS responses, avg(input_tokens) AS i, avg(output_tokens) AS o, avg(cached_input_tokens) AS c FROM usage GROUP BY model)
    SELECT model, responses, round(i, 6) AS input_tokens, round(o, 6) AS output_tokens, round(c, 6) AS cached_input_tokens FROM m
    UNION ALL SELECT NULL, CAST(sum(responses) AS BIGINT), round(avg(i), 6), round(avg(o), 6), round(avg(c), 6) FROM m"""))
def _(t: Tables) -> DataFrame:
    found = aggregate.usage_averages(t.usage().drop("cost"), "model")
    return found.select("model", "responses", *[F.round(c, 6).alias(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens")])


@plan("a22_confidence_histogram", "A22", sql("human", """
    SELECT coder, is_political, CAST(floor(confidence / 1e-1 + 5e-1) AS BIGINT) AS bin, count(*) AS n
    FROM human GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    return aggregate.histogram(t.human(), ["coder", "is_political"], "confidence", 0.1)


@plan("a23_overplot_counts", "A23 W3 G15", sql("ratings", """
    SELECT votes, confidence, rater, count(*) AS n
    FROM (SELECT rater, confidence, about, CAST(sum(CAST(about AS INTEGER)) OVER (PARTITION BY doc_id) AS BIGINT) AS votes FROM ratings)
    WHERE about GROUP BY votes, confidence, rater"""))
def _(t: Tables) -> DataFrame:
    from annolytics.operators.windows import with_group_totals

    voted = with_group_totals(t.ratings(), ["doc_id"], {"votes": F.sum(F.col("about").cast("int"))})
    return aggregate.overplot(voted.where("about"), ["votes", "confidence", "rater"])


@plan("a24_category_order", "A24", sql("theme_rows", """
    SELECT *, row_number() OVER (ORDER BY median, theme) AS place
    FROM (SELECT theme, quantile_cont(CAST(year AS DOUBLE), 0.5) AS median, count(*) AS n FROM theme_rows GROUP BY theme)"""))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return aggregate.category_order(rows, "theme", "year")


@plan("a25_date_range", "A25", sql("chart", """
    SELECT CAST(min(date) AS DATE) AS first, CAST(max(date) AS DATE) AS last, count(*) AS n,
           round(avg(CASE WHEN rank <= 3 THEN 1e0 ELSE 0e0 END), 9) AS share FROM chart"""))
def _(t: Tables) -> DataFrame:
    return t.chart().agg(
        F.min("date").cast("date").alias("first"), F.max("date").cast("date").alias("last"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("rank") <= 3).cast("double")), 9).alias("share"),
    )


