"""Joins, de-duplication, numbering, reshaping and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators import aggregate, dedupe, relational, reshape, sample, windows
from annolytics.plans.preludes import join_key, md5_order, sql
from annolytics.plans.registry import plan
from annolytics.session import materialize
from annolytics.sources.standins import CATEGORIES, RATERS, Tables


@plan("d1_one_row_per_item_and_rater", "D1", sql("raw_ratings", """
    SELECT doc_id, rater, about, confidence, CAST(seq AS INTEGER) AS seq FROM raw_ratings
    QUALIFY row_number() OVER (PARTITION BY doc_id, rater ORDER BY seq DESC) = 1"""))
def _(t: Tables) -> DataFrame:
    out = dedupe.first_per_key(t.raw_ratings(), ["doc_id", "rater"], [-F.col("seq")])
    return out.select("doc_id", "rater", "about", "confidence", "seq")


@plan("d2_best_metadata_per_key", "D2", """
    SELECT event_type, user_id, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, event_id) AS rn FROM events)
    WHERE rn = 1 AND value < 5""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_type", "user_id", "event_id", "value")
    return dedupe.best_scored_per_key(rows, ["event_type", "user_id"], "value", 5.0, ["event_id"])


@plan("d3_first_metadata_per_text", "D3", """
    SELECT md5(text) AS digest, doc_id, lang, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def _(t: Tables) -> DataFrame:
    rows = t.docs().select(text.digest(F.col("text")).alias("digest"), "doc_id", "lang", "source")
    return dedupe.first_per_key(rows, ["digest"], ["doc_id"])


@plan("d4_source_priority", "D4 J9", """
    WITH both_sources AS (SELECT doc_id, quality AS score, 1 AS priority FROM labels
                          UNION ALL SELECT doc_id, CAST(n_chars AS INTEGER) % 2, 2 FROM documents)
    SELECT doc_id, score, priority FROM both_sources
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority) = 1""")
def _(t: Tables) -> DataFrame:
    first = t.raw("labels").select("doc_id", F.col("quality").alias("score"), F.lit(1).alias("priority"))
    second = t.docs().select("doc_id", (F.col("n_chars") % 2).cast("int").alias("score"), F.lit(2).alias("priority"))
    return dedupe.first_per_key(first.unionByName(second), ["doc_id"], ["priority"])


@plan("d5_lowest_score_per_key", "D5 T2", sql("docs", f"""
    SELECT key, doc_id, n_chars FROM (SELECT {join_key("split_part(text, '.', 1)")} AS key, doc_id, n_chars FROM docs)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY n_chars, doc_id) = 1"""))
def _(t: Tables) -> DataFrame:
    heading = F.split_part("text", F.lit("."), F.lit(1))
    rows = t.docs().select(text.join_key(heading).alias("key"), "doc_id", "n_chars")
    return dedupe.first_per_key(rows, ["key"], ["n_chars", "doc_id"])


@plan("d6_distinct_labels", "D6", sql("theme_rows", "SELECT DISTINCT doc_id, rater, theme FROM theme_rows"))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return rows.dropDuplicates(["doc_id", "rater", "theme"]).select("doc_id", "rater", "theme")


@plan("d7_unique_terms", "D7 S3", sql("lexicon docs", """
    SELECT DISTINCT source AS term FROM docs UNION SELECT DISTINCT term FROM lexicon WHERE term IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    terms = t.docs().select(F.col("source").alias("term")).unionByName(t.lexicon().select("term"))
    return dedupe.distinct_values(terms, "term")


@plan("j2_enriched_facts", "J2 D2", sql("docs", """
    SELECT conv_id, turn, f.lang, m.doc_id FROM (SELECT conv_id, turn, role, CASE conv_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr'
             WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'xx' END AS lang FROM conversations) f
    LEFT JOIN (SELECT lang, min(doc_id) AS doc_id FROM docs GROUP BY lang) m USING (lang)"""))
def _(t: Tables) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "xx")])
    facts = t.reasons().select("conv_id", "turn", F.element_at(codes, (F.col("conv_id") % 5 + 1).cast("int")).alias("lang"))
    first = dedupe.first_per_key(t.docs().select("lang", "doc_id"), ["lang"], ["doc_id"])
    return relational.salted_lookup(facts, first, "lang").select("conv_id", "turn", "lang", "doc_id")


@plan("j3_rater_sets_joined", "J3 J7", sql("human ratings", """
    SELECT h.doc_id, h.coder, h.is_political, r.votes FROM human h
    JOIN (SELECT doc_id, CAST(count(*) FILTER (WHERE about) AS BIGINT) AS votes FROM ratings GROUP BY doc_id) r USING (doc_id)"""))
def _(t: Tables) -> DataFrame:
    votes = t.ratings().groupBy("doc_id").agg(F.count_if("about").alias("votes"))
    return t.human().join(votes, "doc_id").select("doc_id", "coder", "is_political", "votes")


@plan("j4_key_filter", "J4", """
    SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(t: Tables) -> DataFrame:
    return relational.keep_keys(t.docs().select("doc_id", "lang"), t.raw("labels").where("toxic = 1"), ["doc_id"])


@plan("j5_items_by_raters", "J5", sql("docs rules", """
    SELECT digest, rater, k FROM (SELECT DISTINCT md5(text) AS digest FROM docs) CROSS JOIN rules"""))
def _(t: Tables) -> DataFrame:
    digests = t.docs().select(text.digest(F.col("text")).alias("digest")).distinct()
    rules = [{"rater": r, "k": i} for i, r in enumerate(RATERS, start=1)]
    return relational.cross_with_dimension(digests, rules, "rater string, k int")


@plan("j6_fuzzy_key_join", "J6 T2", sql("headings", f"""
    SELECT doc_id, page_id FROM (SELECT doc_id, {join_key('title')} AS k FROM headings) JOIN
        (SELECT min(page_id) AS page_id, {join_key("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS k FROM pages GROUP BY k)
        USING (k)"""))
def _(t: Tables) -> DataFrame:
    pages = t.catalogue().select(text.join_key(F.col("title")).alias("k"), F.col("cand_id").alias("page_id"))
    titles = dedupe.first_per_key(pages, ["k"], ["page_id"])
    docs = t.headings().select("doc_id", text.join_key(F.col("title")).alias("k"))
    return relational.salted_lookup(docs, titles, "k", how="inner").select("doc_id", "page_id")


@plan("j8_columns_beside_an_id", "J8", """
    SELECT doc_id, length(text) AS n, quality FROM documents JOIN labels USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    sizes = t.docs().select("doc_id", F.length("text").cast("long").alias("n"))
    return sizes.join(t.raw("labels"), "doc_id").select("doc_id", "n", "quality")


@plan("j9_tagged_union", "J9", sql("human ratings", """
    SELECT doc_id, coder AS rater, is_political = 1 AS about, 'human' AS kind, NULL::DOUBLE AS confidence FROM human
    UNION ALL SELECT doc_id, rater, about, 'model', confidence FROM ratings WHERE doc_id IN (SELECT doc_id FROM human)"""))
def _(t: Tables) -> DataFrame:
    human = t.human().select("doc_id", F.col("coder").alias("rater"), (F.col("is_political") == 1).alias("about"))
    model = relational.keep_keys(t.ratings().select("doc_id", "rater", "about", "confidence"), t.raw("labels"), ["doc_id"])
    return relational.union_tagged({"human": human, "model": model}, "kind")


@plan("j11_unfinished_work", "J11", sql("docs rules", """
    SELECT doc_id, rater FROM docs CROSS JOIN rules
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = docs.doc_id AND rules.k <= 5)"""))
def _(t: Tables) -> DataFrame:
    rules = [{"rater": r} for r in RATERS]
    work = relational.cross_with_dimension(t.docs().select("doc_id"), rules, "rater string")
    done = relational.cross_with_dimension(t.raw("labels").select("doc_id"), rules[:5], "rater string")
    return relational.unfinished(work, done, ["doc_id", "rater"])


@plan("w1_global_batches", "W1 F3", """
    SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 100 + 1 AS BIGINT) AS batch FROM orders""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("orders").select("o_orderkey", "o_totalprice")
    return windows.batch_ids(rows, ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "batch")


@plan("w2_batches_per_rater", "W2", """
    SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1)
               // CASE event_type WHEN 'view' THEN 50 ELSE 20 END + 1 AS BIGINT) AS batch FROM events""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select(
        "event_id", "event_type", text.digest(F.col("event_id").cast("string")).alias("digest"),
        F.when(F.col("event_type") == "view", 50).otherwise(20).alias("size"),
    )
    return windows.batch_ids(rows, ["digest", "event_id"], "size", ["event_type"]).select("event_id", "event_type", "batch")


@plan("w3_votes_on_rows", "W3", sql("ratings", """
    SELECT doc_id, rater, CAST(sum(CAST(about AS INTEGER)) OVER (PARTITION BY doc_id) AS BIGINT) AS votes FROM ratings"""))
def _(t: Tables) -> DataFrame:
    totals = {"votes": F.sum(F.col("about").cast("int"))}
    return windows.with_group_totals(t.ratings(), ["doc_id"], totals).select("doc_id", "rater", "votes")


@plan("w4_single_voter_items", "W4 G13 N2", sql("ratings", """
    SELECT doc_id, rater FROM (SELECT *, sum(CAST(about AS INTEGER)) OVER w AS votes, count(about) OVER w AS given,
                                      count(*) OVER w AS n FROM ratings WINDOW w AS (PARTITION BY doc_id))
    WHERE votes = 1 AND given = n AND about"""))
def _(t: Tables) -> DataFrame:
    totals = {"votes": F.sum(F.col("about").cast("int")), "given": F.count("about"), "n": F.count(F.lit(1))}
    rows = windows.with_group_totals(t.ratings(), ["doc_id"], totals)
    lone = (F.col("votes") == 1) & (F.col("given") == F.col("n")) & F.col("about")
    return rows.where(lone).select("doc_id", "rater")


@plan("w5_top_six_per_measure", "W5", """
    WITH long AS (SELECT * FROM (SELECT page_id, length(html) AS html_chars, length(url) AS url_chars FROM pages)
                  UNPIVOT (score FOR measure IN (html_chars, url_chars)))
    SELECT measure, page_id, score, CAST(row_number() OVER (PARTITION BY measure ORDER BY score DESC, page_id) AS INTEGER) AS rank
    FROM long QUALIFY rank <= 6""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("pages").select(
        "page_id", F.length("html").cast("long").alias("html_chars"), F.length("url").cast("long").alias("url_chars")
    )
    long = reshape.long(rows, ["page_id"], ["html_chars", "url_chars"], "measure", "score")
    return windows.top_per_group(long, ["measure"], [F.desc("score"), F.asc("page_id")], 6)


@plan("w6_w7_first_ten", "W6 W7", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return t.docs().select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@plan("w8_five_bins", "W8", sql("ratings", """
    WITH shares AS (SELECT avg(CAST(about AS DOUBLE)) AS x FROM ratings GROUP BY doc_id),
    bounds AS (SELECT min(x) AS lo, max(x) AS hi FROM shares)
    SELECT CAST(greatest(1, least(5, ceil((x - lo) / ((hi - lo) / 5)))) AS INTEGER) AS bin, count(*) AS n
    FROM shares, bounds WHERE x IS NOT NULL GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    summary = aggregate.item_summary(t.ratings(), ["doc_id"], "about", "confidence")
    return windows.cut_counts(summary, "share", 5)


@plan("w9_first_maximum", "W9", """
    SELECT CASE WHEN max(n) > 0 THEN arg_max(lang, (n, -k)) ELSE 70 END AS lang FROM (
        SELECT k AS lang, k, count(*) FILTER (WHERE doc_id % 5 = k) AS n FROM documents, range(5) AS r(k) GROUP BY k)""")
def _(t: Tables) -> DataFrame:
    scores = t.docs().groupBy((F.col("doc_id") % 5).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return windows.first_maximum(scores, "lang", "n", 70)


@plan("w10_letter_aliases", "W10 U2", """
    SELECT lang, chr(CAST(64 + dense_rank() OVER (ORDER BY lang) AS INTEGER)) AS letter FROM (SELECT DISTINCT lang FROM documents)""")
def _(t: Tables) -> DataFrame:
    return windows.letter_aliases(t.docs(), "lang", "letter")


@plan("n1_wide_labels", "N1", sql("ratings", f"""
    SELECT doc_id, {', '.join(f"bool_or(about) FILTER (WHERE rater = '{r}') AS about_{r}" for r in RATERS)}
    FROM ratings GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    return reshape.wide(t.ratings(), ["doc_id"], "rater", ["about"], RATERS)


@plan("n2_wide_values", "N2", sql("human", """
    SELECT doc_id, max(is_political) FILTER (WHERE coder = 'coder_a') AS is_political_coder_a,
           max(is_political) FILTER (WHERE coder = 'coder_b') AS is_political_coder_b,
           max(confidence) FILTER (WHERE coder = 'coder_a') AS confidence_coder_a,
           max(confidence) FILTER (WHERE coder = 'coder_b') AS confidence_coder_b FROM human GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    return reshape.wide(t.human(), ["doc_id"], "coder", ["is_political", "confidence"], ["coder_a", "coder_b"])


@plan("n4_labels_with_empty", "N4", sql("theme_pairs theme_rows", """
    SELECT p.doc_id, p.rater, r.theme FROM theme_pairs p LEFT JOIN theme_rows r ON p.doc_id = r.doc_id AND p.rater = r.rater"""))
def _(t: Tables) -> DataFrame:
    return reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=True).select("doc_id", "rater", "theme")


@plan("n6_nested_structs", "N6", """
    SELECT o_custkey, count(*) AS orders, round(max(o_totalprice), 2) AS price,
           arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS priority FROM orders GROUP BY o_custkey""")
def _(t: Tables) -> DataFrame:
    best = F.max(F.struct("o_totalprice", "o_orderkey", "o_orderpriority")).alias("best")
    nested = t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.array(best).alias("list"))
    flat = nested.select("o_custkey", "orders", F.inline("list"))
    return flat.select("o_custkey", "orders", F.round("o_totalprice", 2).alias("price"), F.col("o_orderpriority").alias("priority"))


@plan("n7_lumped_labels", "N7", sql("theme_rows", """
    WITH ranked AS (SELECT theme, rank() OVER (ORDER BY count(*) DESC) AS r FROM theme_rows GROUP BY theme)
    SELECT CASE WHEN r <= 5 THEN theme ELSE 'Other' END AS theme, count(*) AS n
    FROM theme_rows JOIN ranked USING (theme) GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    rows = materialize(reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False).select("theme"), "themes")
    return reshape.lump_rare(rows, "theme", 5).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


_PRESENCE_SQL = """
    SELECT p.doc_id, p.rater, c.category AS theme, CAST(r.theme IS NOT NULL AS INTEGER) AS present
    FROM {pairs} p CROSS JOIN category_words c LEFT JOIN theme_rows r
      ON r.doc_id = p.doc_id AND r.rater = p.rater AND r.theme = c.category"""


@plan("n8_presence", "N8", sql("theme_pairs theme_rows category_words", _PRESENCE_SQL.format(pairs="theme_pairs")))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=True)
    return reshape.presence(rows, ["doc_id"], "rater", "theme", CATEGORIES)


@plan("n8_presence_absent_as_zero", "N8", sql("theme_pairs theme_rows category_words", _PRESENCE_SQL.format(pairs="""
    (SELECT doc_id, rater FROM (SELECT DISTINCT doc_id FROM theme_rows) CROSS JOIN (SELECT DISTINCT rater FROM theme_pairs))""")))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    return reshape.presence(rows, ["doc_id"], "rater", "theme", CATEGORIES, RATERS[:8])


PROFILE_SQL = """
    SELECT rater, category AS theme, avg(CAST(r.theme IS NOT NULL AS INTEGER)) AS mean
    FROM (SELECT DISTINCT doc_id, rater FROM theme_rows) p CROSS JOIN category_words c
    LEFT JOIN (SELECT doc_id, rater, theme FROM theme_rows) r
      ON r.doc_id = p.doc_id AND r.rater = p.rater AND r.theme = c.category GROUP BY rater, category"""


def profiles(t: Tables) -> DataFrame:
    """Mean presence of each theme per rater, over the documents where the rater named any."""
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=False)
    shown = reshape.presence(rows, ["doc_id"], "rater", "theme", CATEGORIES)
    return shown.groupBy("rater", "theme").agg(F.avg("present").alias("mean"))


@plan("n9_rater_profiles", "N9", sql("theme_rows category_words", f"""
    SELECT rater, theme, round(mean, 9) AS mean FROM (""" + PROFILE_SQL.replace("rater, category AS theme", "p.rater, category AS theme").replace("GROUP BY rater", "GROUP BY p.rater") + ")"))
def _(t: Tables) -> DataFrame:
    return profiles(t).withColumn("mean", F.round("mean", 9))


@plan("m1_simple_sample", "M1", f"SELECT doc_id, lang FROM documents ORDER BY {md5_order('doc_id', 42)}, doc_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return sample.simple(t.docs(), "doc_id", 100, 42).select("doc_id", "lang")


@plan("m2_two_strata", "M2", sql("ratings", f"""
    WITH s AS (SELECT doc_id, CAST(count(*) FILTER (WHERE about) AS BIGINT) AS votes FROM ratings GROUP BY doc_id),
    tagged AS (SELECT *, CASE WHEN votes = 0 THEN 'none' WHEN votes >= 4.5 THEN 'half' END AS stratum FROM s)
    SELECT doc_id, votes, stratum FROM tagged WHERE stratum IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {md5_order('doc_id', 42)}, doc_id) <= 300"""))
def _(t: Tables) -> DataFrame:
    votes = aggregate.item_summary(t.ratings(), ["doc_id"], "about", "confidence").select("doc_id", "votes")
    strata = {"none": F.col("votes") == 0, "half": F.col("votes") >= len(RATERS) / 2}
    return sample.stratified(votes, strata, "doc_id", 300, 42)


@plan("m3_two_per_group", "M3 L8", f"""
    SELECT source, doc_id FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY {md5_order('doc_id', 7)}, doc_id) <= 2""")
def _(t: Tables) -> DataFrame:
    return sample.per_group(t.docs().select("source", "doc_id"), ["source"], "doc_id", 2, 7)
