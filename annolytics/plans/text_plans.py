"""Text functions, projections, predicates and scalars over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.functions.html import PageSpec, Selector, page_text
from annolytics.operators import aggregate, annotate, relational, reshape
from annolytics.plans.preludes import clean, join_key, match, sql, words
from annolytics.plans.registry import plan
from annolytics.plans.rollup_plans import FLAG_PATTERNS
from annolytics.session import spread
from annolytics.session import materialize
from annolytics.sources.standins import CODERS, RATERS, Tables


@plan("t1_clean_text", "T1", sql("docs", f"SELECT doc_id, md5({clean('text')}) AS cleaned FROM docs"))
def _(t: Tables) -> DataFrame:
    return t.docs().select("doc_id", text.digest(text.clean_text(F.col("text"))).alias("cleaned"))


@plan("t2_join_key", "T2", sql("docs", f"SELECT doc_id, md5({join_key('text')}) AS key FROM docs"))
def _(t: Tables) -> DataFrame:
    return t.docs().select("doc_id", text.digest(text.join_key(F.col("text"))).alias("key"))


@plan("t3_match_text", "T3", sql("docs", f"""
    SELECT 'd' || doc_id AS id, md5({match("text || ' (live) & more [x] Feat. Someone'")}) AS key FROM docs
    UNION ALL SELECT 'p' || page_id, md5({match("html")}) FROM pages"""))
def _(t: Tables) -> DataFrame:
    decorated = F.concat("text", F.lit(" (live) & more [x] Feat. Someone"))
    docs = t.docs().select(
        F.concat(F.lit("d"), "doc_id").alias("id"), text.digest(text.match_text(decorated)).alias("key")
    )
    pages = t.raw("pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), text.digest(text.match_text(F.col("html"))).alias("key")
    )
    return docs.unionByName(pages)


@plan("t4_keyword_flags", "T4 U3", sql("docs", f"""
    SELECT doc_id, {', '.join(f"regexp_matches(c, '{p}') AS keyword_{k}" for k, p in text.KEYWORD_PATTERNS.items())},
           {', '.join(f"regexp_matches(c, '{p}') AS other_{k}" for k, p in FLAG_PATTERNS.items())}
    FROM (SELECT doc_id, {clean('text')} AS c FROM docs)"""))
def _(t: Tables) -> DataFrame:
    cleaned = t.docs().select("doc_id", text.clean_text(F.col("text")).alias("_c"))
    others = [F.col("_c").rlike(p).alias(f"other_{k}") for k, p in FLAG_PATTERNS.items()]
    return cleaned.select("doc_id", *text.keyword_flags(F.col("_c")), *others)


@plan("t5_title_case_and_mask", "T5", """
    SELECT part.p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '),
               lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
           replace(p_name, 'bolt', 'screw') AS replaced,
           CASE WHEN lower(split_part(p_name, ' ', 1)) IN ('red', 'small')
                THEN left(split_part(p_name, ' ', 1), 1) || repeat('*', length(split_part(p_name, ' ', 1)) - 1)
                ELSE split_part(p_name, ' ', 1) END AS masked FROM part""")
def _(t: Tables) -> DataFrame:
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.initcap("p_name").alias("title"),
        F.replace("p_name", F.lit("bolt"), F.lit("screw")).alias("replaced"),
        text.mask_listed(first, ["Red", "Small"]).alias("masked"),
    )


@plan("t6_table_cells", "T6", sql("reasons", r"""
    SELECT conv_id, turn, CASE WHEN length(c) > 150 THEN left(c, 147) || '...' ELSE c END AS cell
    FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(text, '|', '/'), '[\r\n]+', ' / ', 'g'),
                 '\s+', ' ', 'g')) AS c FROM reasons)"""))
def _(t: Tables) -> DataFrame:
    return t.reasons().select("conv_id", "turn", text.truncate(text.table_cell(F.col("text")), 150).alias("cell"))


@plan("t7_markdown_table", "T7", r"""
    SELECT part, CASE WHEN part = 1 THEN '| n_name | n_regionkey |' || chr(10) || '| --- | --- |' || chr(10) ELSE '' END ||
           string_agg('| ' || replace(n_name, '|', '\|') || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_name) AS "table"
    FROM (SELECT *, (row_number() OVER (ORDER BY n_name) - 1) // 10 + 1 AS part FROM nation) GROUP BY part""")
def _(t: Tables) -> DataFrame:
    return annotate.markdown_table(t.raw("nation"), ["n_name", "n_regionkey"], "n_name", rows_per_part=10)


TEMPLATE = 'Text by "{{source}}" in {{lang}} from {{year}}:\n\n{{body}}\n\nAnswer as JSON: \\{"about": "boolean"\\}'
TEMPLATE_SQL = (
    "'Text by \"' || source || '\" in ' || lang || ' from ' || year || ':' || chr(10) || chr(10) || text || chr(10) || "
    "chr(10) || 'Answer as JSON: {\"about\": \"boolean\"}'"
)


@plan("t8_t9_prompts_and_digests", "T8 T9 P1", sql("docs", f"""
    SELECT doc_id, length({TEMPLATE_SQL}) AS n, md5({TEMPLATE_SQL}) AS prompt_digest FROM docs"""))
def _(t: Tables) -> DataFrame:
    slots = {"source": F.col("source"), "lang": F.col("lang"), "year": F.col("year"), "body": F.col("text")}
    out = annotate.prompts(t.docs(), TEMPLATE, slots)
    return out.select("doc_id", F.length("prompt").cast("long").alias("n"), "prompt_digest")


@plan("t10_numbered_digest", "T10", sql("reasons", """
    SELECT coder, CAST((rn - 1) // 500 + 1 AS BIGINT) AS part, count(*) AS lines,
           md5(string_agg(rn || '. ' || text, chr(10) ORDER BY rn)) AS digest
    FROM (SELECT *, row_number() OVER (PARTITION BY coder ORDER BY conv_id, turn) AS rn FROM reasons WHERE length(trim(text)) > 0)
    GROUP BY 1, 2"""))
def _(t: Tables) -> DataFrame:
    out = annotate.group_digest(t.reasons(), "coder", ["conv_id", "turn"], "text", 500)
    return out.withColumn("digest", text.digest(F.col("digest")))


PAGE_SPEC = PageSpec(
    containers=((Selector("div", "data-body", "=", "true"),), (Selector("article"),)),
    drop=(Selector("div", "class", "=", "ad"), Selector("nav"), Selector("footer")),
)


@plan("t11_page_text", "T11 T12")
def _(t: Tables) -> DataFrame:
    pages = spread(t.raw("pages").select("page_id", "html"), "page_id")
    out = pages.select("page_id", page_text(F.col("html"), PAGE_SPEC).alias("body"))
    status = F.when(F.col("body").isNull(), "lyrics_not_found").otherwise("ok")
    return out.select("page_id", F.length("body").alias("n_chars"), text.digest(F.col("body")).alias("digest"), status.alias("status"))


@plan("t13_prefix_strip", "T13 N3 P2", sql("ratings", """
    SELECT doc_id, replace(rater, 'rater_', '') AS rater, about FROM ratings"""))
def _(t: Tables) -> DataFrame:
    wide = reshape.wide(t.ratings(), ["doc_id"], "rater", ["about"], RATERS)
    picked = reshape.select_prefixed(wide, ["doc_id"], "about_")
    long = reshape.long(picked, ["doc_id"], picked.columns[1:], "name", "about")
    return long.select("doc_id", F.regexp_replace("name", "^about_rater_", "").alias("rater"), "about")


@plan("p2_snake_names", "S2 P2", """
    SELECT r_regionkey AS region_key, r_name AS region_name_percent, r_name AS region_name_percent_2 FROM region""")
def _(t: Tables) -> DataFrame:
    odd = t.raw("region").select(
        F.col("r_regionkey").alias("Region Key"), F.col("r_name").alias("region_name %"), F.col("r_name").alias("RegionName%"),
        F.lit(1).alias("unused"),
    )
    return reshape.rename_snake(reshape.drop_present(odd, ["unused", "never there"]))


@plan("p3_usable_records", "P3", sql("docs", """
    SELECT doc_id, quality FROM docs JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text <> ''"""))
def _(t: Tables) -> DataFrame:
    joined = relational.lookup(t.docs(), t.raw("labels"), "doc_id")
    needed = F.col("quality").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull()
    return joined.where(needed & (F.col("text") != "")).select("doc_id", "quality")


@plan("p7_consensus_category", "P7 P13 G10", sql("human", """
    SELECT doc_id, CASE WHEN min(is_political) = 1 AND count(is_political) = 2 THEN 'both yes'
                        WHEN max(is_political) = 0 AND count(is_political) = 2 THEN 'both no' ELSE 'disagree' END AS consensus
    FROM human GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    wide = reshape.wide(t.human(), ["doc_id"], "coder", ["is_political"], CODERS)
    flags = [F.col(f"is_political_{c}") for c in CODERS]
    label = F.when(aggregate.all_same(flags, 1), "both yes").when(aggregate.all_same(flags, 0), "both no").otherwise("disagree")
    return wide.select("doc_id", label.alias("consensus"))


@plan("p8_recode_labels", "P8 J1", """
    SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables) -> DataFrame:
    nation = t.raw("nation").withColumnRenamed("n_nationkey", "s_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    named = relational.lookup(t.raw("supplier"), nation, "s_nationkey")
    placed = relational.lookup(named, t.raw("region"), "r_regionkey")
    return placed.select(
        "s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region")
    )


@plan("p9_p10_fill_and_format", "P9 P10 F2", """
    SELECT doc_id, CAST(coalesce(quality, 0) AS INTEGER) AS quality,
           printf('%.1f%%', 1e2 * coalesce(quality, 0)) AS percent,
           round(CAST(n_chars AS DOUBLE) / 7e0, 3) AS score,
           greatest(coalesce(quality, 0), 1) AS at_least_one
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    joined = relational.lookup(t.raw("documents"), t.raw("labels"), "doc_id").fillna(0, ["quality"])
    return joined.select(
        "doc_id", "quality", F.format_string("%.1f%%", 100.0 * F.col("quality")).alias("percent"),
        F.round(F.col("n_chars").cast("double") / 7.0, 3).alias("score"), F.greatest("quality", F.lit(1)).alias("at_least_one"),
    )


@plan("p10_score_format", "P10", """
    SELECT l_linenumber, CASE WHEN (SELECT bool_and(l_quantity = floor(l_quantity)) FROM lineitem)
                              THEN printf('%.0f', sum(l_quantity)) ELSE printf('%.3f', sum(l_quantity)) END AS quantity,
           CASE WHEN (SELECT bool_and(l_tax = floor(l_tax)) FROM lineitem)
                              THEN printf('%.0f', max(l_tax)) ELSE printf('%.3f', max(l_tax)) END AS tax
    FROM lineitem GROUP BY l_linenumber""")
def _(t: Tables) -> DataFrame:
    items = t.raw("lineitem")
    whole = [F.bool_and(F.col(c) == F.floor(c)).alias(c) for c in ("l_quantity", "l_tax")]
    sums = materialize(items.groupBy("l_linenumber").agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("x"), *whole), "sums")
    all_whole = sums.agg(*[F.bool_and(c).alias(c) for c in ("l_quantity", "l_tax")]).first()
    patterns = {c: "%.0f" if all_whole[c] else "%.3f" for c in ("l_quantity", "l_tax")}
    return sums.select(
        "l_linenumber", F.format_string(patterns["l_quantity"], "q").alias("quantity"),
        F.format_string(patterns["l_tax"], "x").alias("tax"),
    )


@plan("p11_casts", "P11 F7", r"""
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           TRY_CAST(nullif(event_type, 'view') AS DOUBLE) AS none, CAST(event_id % 2 AS BOOLEAN) AS odd
    FROM events""")
def _(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "k int, missing string")
    return t.raw("events").select(
        "event_id", parsed["k"].alias("k"), F.nullif("event_type", F.lit("view")).try_cast("double").alias("none"),
        (F.col("event_id") % 2).cast("boolean").alias("odd"),
    )


@plan("p12_true_counts", "P12", sql("ratings", """
    SELECT doc_id, CAST(count(*) FILTER (WHERE about) AS INTEGER) AS votes FROM ratings GROUP BY doc_id"""))
def _(t: Tables) -> DataFrame:
    wide = reshape.wide(t.ratings(), ["doc_id"], "rater", ["about"], RATERS)
    return wide.select("doc_id", aggregate.count_true([F.col(c) for c in wide.columns[1:]]).alias("votes"))


@plan("f_scalars", "F1 F3 F4 F6", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey // 100 + 1 AS BIGINT) AS batch,
           length(trim(o_orderpriority)) > 0 AS has_text, round(log10(o_totalprice), 9) AS magnitude
    FROM orders WHERE o_totalprice > 0""")
def _(t: Tables) -> DataFrame:
    return t.raw("orders").where(F.col("o_totalprice") > 0).select(
        "o_orderkey", F.year("o_orderdate").alias("year"), (F.floor(F.col("o_orderkey") / 100) + 1).cast("long").alias("batch"),
        (F.length(F.trim("o_orderpriority")) > 0).alias("has_text"), F.round(F.log10("o_totalprice"), 9).alias("magnitude"),
    )


@plan("f5_term_overlap", "F5", sql("docs", f"""
    SELECT doc_id, CAST(len(list_filter({words('text')}, lambda w: w IN ('the', 'und', 'la', 'des'))) AS INTEGER) AS hits FROM docs"""))
def _(t: Tables) -> DataFrame:
    found = F.filter(text.tokens(text.clean_text(F.col("text"))), lambda w: w.isin("the", "und", "la", "des"))
    return t.docs().select("doc_id", F.size(found).alias("hits"))


@plan("n10_simplified_variants", "N10 F8", """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number,
           CAST(event_id % 2 AS BOOLEAN) AS flag, event_type AS word FROM events""")
def _(t: Tables) -> DataFrame:
    raw = t.raw("events").select(
        "event_id", F.get_json_object("props", "$.k").alias("number"),
        F.when(F.col("event_id") % 2 == 1, "true").otherwise("false").alias("flag"),
        F.concat(F.lit('"'), "event_type", F.lit('"')).alias("word"),
    )
    return reshape.simplify_variants(raw, "number", "flag", "word")


