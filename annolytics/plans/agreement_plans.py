"""Agreement, correlation and validation of raters."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.functions.stats import ERF_A, ERF_P, Z_975
from annolytics.operators import aggregate, agreement, dedupe, relational, reshape, sample
from annolytics.plans.preludes import join_key, md5_order, sql
from annolytics.plans.registry import plan
from annolytics.plans.table_plans import PROFILE_SQL, profiles
from annolytics.session import materialize
from annolytics.sources.standins import CATEGORIES, CODERS, RATERS, Tables

_Z = repr(Z_975) + "e0"


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def kappa_sql(pairs: str, by: str = "") -> str:
    """Cohen's kappa of ``pairs(by, a, b)`` written out with margins per label."""
    group = f"{by}, " if by else ""
    using = f"USING ({by}, label)" if by else "USING (label)"
    x = "(abs(z) / sqrt(2e0))"
    tt = f"(1e0 / (1e0 + {ERF_P}e0 * {x}))"
    poly = "0e0"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + ({a}e0)) * {tt}"
    return f"""
    pairs AS ({pairs}), used AS (SELECT * FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
    ra AS (SELECT {group}a AS label, CAST(count(*) AS DOUBLE) AS r FROM used GROUP BY {group}a),
    cb AS (SELECT {group}b AS label, CAST(count(*) AS DOUBLE) AS c FROM used GROUP BY {group}b),
    m AS (SELECT {group}coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM ra FULL JOIN cb {using}),
    tot AS (SELECT {group}CAST(count(*) AS DOUBLE) AS n, avg(CAST(a = b AS INTEGER)) AS po FROM used {'GROUP BY ' + by if by else ''}),
    e AS (SELECT {group}n, po, (SELECT sum(r * c) FROM m {f'WHERE m.{by} = tot.{by}' if by else ''}) / (n * n) AS pe,
                 (SELECT sum(r * c * (r + c)) FROM m {f'WHERE m.{by} = tot.{by}' if by else ''}) / (n * n * n) AS third FROM tot),
    k AS (SELECT *, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa, (pe + pe * pe - third) / (n * (1 - pe) * (1 - pe)) AS v FROM e),
    zz AS (SELECT *, kappa / sqrt(v) AS z FROM k)
    SELECT {group}CAST(n AS BIGINT) AS n, round(po, 9) AS agreement, round(kappa, 9) AS kappa, round(z, 6) AS z,
           round({poly} * exp(-{x} * {x}), 7) AS p FROM zz"""


def _kappa_out(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, 9, "agreement", "kappa"), 6, "z").withColumn("p", F.round("p", 7))


@plan("g1_percent_agreement", "G1", sql("ratings", """
    SELECT count(*) AS n, round(avg(CAST(a.about = b.about AS INTEGER)), 9) AS agreement
    FROM ratings a JOIN ratings b USING (doc_id)
    WHERE a.rater = 'rater_2' AND b.rater = 'rater_5' AND a.about IS NOT NULL AND b.about IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    return _rounded(agreement.percent_agreement(t.ratings(), "doc_id", "rater", "about", "rater_2", "rater_5"), 9, "agreement")


@plan("g2_cohen_kappa_coders", "G2", sql("human", "WITH " + kappa_sql("""
    SELECT max(is_political) FILTER (WHERE coder = 'coder_a') AS a, max(is_political) FILTER (WHERE coder = 'coder_b') AS b
    FROM human GROUP BY doc_id""").strip()))
def _(t: Tables) -> DataFrame:
    wide = reshape.wide(t.human(), ["doc_id"], "coder", ["is_political"], CODERS)
    return _kappa_out(agreement.cohen_kappa(wide, "is_political_coder_a", "is_political_coder_b"))


@plan("g3_kappa_against_consensus", "G3", sql("human ratings", "WITH " + kappa_sql("""
    SELECT rater, about AS a, truth AS b FROM ratings JOIN (
        SELECT doc_id, min(is_political) = 1 AS truth FROM human GROUP BY doc_id
        HAVING count(is_political) = 2 AND min(is_political) = max(is_political)) USING (doc_id)""", "rater").strip()))
def _(t: Tables) -> DataFrame:
    flags = t.human().withColumn("flag", F.col("is_political") == 1)
    agreed = agreement.consensus(flags, "doc_id", "flag", 2)
    truth = agreed.withColumn("truth", F.when(F.col("consensus") == "yes", True).when(F.col("consensus") == "no", False))
    return _kappa_out(agreement.kappa_against(t.ratings(), truth, "doc_id", "rater", "about", "truth"))


@plan("g3_kappa_against_majority", "G3", sql("ratings", "WITH " + kappa_sql("""
    SELECT rater, about AS a, truth AS b FROM ratings JOIN (
        SELECT doc_id, count(*) FILTER (WHERE about) > 4.5 AS truth FROM ratings GROUP BY doc_id) USING (doc_id)""", "rater").strip()))
def _(t: Tables) -> DataFrame:
    truth = t.ratings().groupBy("doc_id").agg((F.count_if("about") > len(RATERS) / 2).alias("truth"))
    return _kappa_out(agreement.kappa_against(t.ratings(), truth, "doc_id", "rater", "about", "truth"))


@plan("g4_fleiss_complete", "G4", sql("ratings", """
    WITH c AS (SELECT doc_id, CAST(count(*) FILTER (WHERE about) AS DOUBLE) AS y, CAST(count(*) FILTER (WHERE NOT about) AS DOUBLE) AS n
               FROM ratings GROUP BY doc_id HAVING count(about) = 9),
    s AS (SELECT count(*) AS items, avg((y * y + n * n - 9) / 72) AS po, sum(y) AS ty, sum(n) AS tn FROM c),
    e AS (SELECT items, po, pow(ty / (items * 9), 2) + pow(tn / (items * 9), 2) AS pe FROM s)
    SELECT items, round((po - pe) / (1 - pe), 9) AS kappa FROM e"""))
def _(t: Tables) -> DataFrame:
    return _rounded(agreement.fleiss_complete(t.ratings(), ["doc_id"], "about", [True, False], len(RATERS)), 9, "kappa")


def fleiss_sql(counts: str, by: str = "") -> str:
    """Kappa with missing ratings and its interval from ``counts(by, y, n)``, as a two-pass computation."""
    group, over = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    nu = "(n - 1)"
    z = _Z
    tq = (
        f"(CASE {nu} WHEN 1 THEN 12.706204736432095e0 WHEN 2 THEN 4.302652729911275e0 WHEN 3 THEN 3.182446305284263e0 "
        f"WHEN 4 THEN 2.7764451051977987e0 "
        f"ELSE {z} + (pow({z}, 3) + {z}) / 4 / {nu} + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / 96 / pow({nu}, 2) "
        f"+ (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / 384 / pow({nu}, 3) END)"
    )
    return f"""
    counts AS ({counts}), rated AS (SELECT *, y + n AS r FROM counts WHERE y + n > 0),
    i AS (SELECT {group}y / r AS sy, n / r AS sn, r,
                 CASE WHEN r >= 2 THEN (y * (y - 1) + n * (n - 1)) / (r * (r - 1)) END AS pa FROM rated),
    g AS (SELECT *, avg(pa) OVER ({over}) AS po, avg(sy) OVER ({over}) AS py, avg(sn) OVER ({over}) AS pn,
                 CAST(count(*) OVER ({over}) AS DOUBLE) AS n, CAST(count(pa) OVER ({over}) AS DOUBLE) AS n2 FROM i),
    h AS (SELECT *, py * py + pn * pn AS pe, (po - py * py - pn * pn) / nullif(1 - py * py - pn * pn, 0) AS kappa FROM g),
    s AS (SELECT *, CASE WHEN r >= 2 THEN (n / n2) * (pa - pe) / nullif(1 - pe, 0) ELSE 0 END
                    - 2 * (1 - kappa) * (py * sy + pn * sn - pe) / nullif(1 - pe, 0) AS star FROM h),
    v AS (SELECT {group}max(n) AS n, max(kappa) AS kappa, sqrt(sum(pow(star - kappa, 2)) / nullif(max(n) * (max(n) - 1), 0)) AS se
          FROM s {'GROUP BY ' + by if by else ''})
    SELECT {group}CAST(n AS BIGINT) AS items, round(kappa, 8) AS kappa, round(se, 6) AS se, round(kappa - {tq} * se, 6) AS low,
           CASE WHEN kappa IS NOT NULL AND se IS NOT NULL THEN round(least(kappa + {tq} * se, 1e0), 6) END AS high FROM v"""


def _fleiss_out(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, 8, "kappa"), 6, "se", "low", "high")


_COUNTS = "CAST(count(*) FILTER (WHERE about) AS DOUBLE) AS y, CAST(count(*) FILTER (WHERE NOT about) AS DOUBLE) AS n"


@plan("g5_fleiss_available", "G5", sql("ratings", "WITH " + fleiss_sql(f"SELECT {_COUNTS} FROM ratings GROUP BY doc_id").strip()))
def _(t: Tables) -> DataFrame:
    return _fleiss_out(agreement.fleiss_available(t.ratings(), ["doc_id"], "about", [True, False]))


@plan("g5_fleiss_per_year", "G5", sql("ratings", "WITH " + fleiss_sql(f"SELECT year, {_COUNTS} FROM ratings GROUP BY year, doc_id", "year").strip()))
def _(t: Tables) -> DataFrame:
    return _fleiss_out(agreement.fleiss_available(t.ratings(), ["doc_id"], "about", [True, False], ["year"]))


def alpha_sql(counts: str, by: str = "") -> str:
    """Alpha by its definition, and its variance from the linearised alpha of every item."""
    group = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    nu, z = "(items - 1)", _Z
    tq = (
        f"(CASE {nu} WHEN 1 THEN 12.706204736432095e0 WHEN 2 THEN 4.302652729911275e0 WHEN 3 THEN 3.182446305284263e0 "
        f"WHEN 4 THEN 2.7764451051977987e0 "
        f"ELSE {z} + (pow({z}, 3) + {z}) / 4 / {nu} + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / 96 / pow({nu}, 2) "
        f"+ (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / 384 / pow({nu}, 3) END)"
    )
    return f"""
    u AS (SELECT *, y + n AS m, (y * (y - 1) + n * (n - 1)) / (y + n - 1) AS s FROM ({counts}) WHERE y + n >= 2),
    w AS (SELECT *, count(*) OVER ({over}) AS items, sum(m) OVER ({over}) AS t, sum(s) OVER ({over}) AS ts, sum(y) OVER ({over}) AS ty, sum(n) OVER ({over}) AS tn FROM u),
    e AS (SELECT *, t / items AS r, ts / t AS pa, pow(ty / t, 2) + pow(tn / t, 2) AS pe,
                 1 - (1 - ts / t) / nullif((t * t - ty * ty - tn * tn) / (t * (t - 1)), 0) AS alpha FROM w),
    x AS (SELECT *, (s / r - pa * (m - r) / r - pe) / nullif(1 - pe, 0)
                    - 2 * (1 - (pa - pe) / nullif(1 - pe, 0)) * ((ty * y + tn * n) / t / r - pe * (m - r) / r - pe) / nullif(1 - pe, 0)
                    - (pa - pe) / nullif(1 - pe, 0) AS off FROM e),
    v AS (SELECT {group}max(items) AS items, max(alpha) AS alpha, sqrt(sum(off * off) / (max(items) * nullif(max(items) - 1e0, 0))) AS se
          FROM x {'GROUP BY ' + by if by else 'HAVING count(*) > 0'})
    SELECT {group}items, round(alpha + 1e-11, 9) AS alpha, round(se + 1e-11, 7) AS se, round(alpha - {tq} * se + 1e-11, 7) AS low,
           CASE WHEN alpha IS NOT NULL AND se IS NOT NULL THEN round(least(alpha + {tq} * se, 1e0) + 1e-11, 7) END AS high FROM v"""


def _alpha_out(df: DataFrame) -> DataFrame:
    """Moved off the half-way points, which binary fractions hit, before they are rounded."""
    moved = df.withColumns({c: F.col(c) + 1e-11 for c in ("alpha", "se", "low", "high")})
    return _rounded(_rounded(moved, 9, "alpha"), 7, "se", "low", "high")


@plan("g6_krippendorff_alpha", "G6", sql("ratings", "WITH " + alpha_sql(f"SELECT {_COUNTS} FROM ratings GROUP BY doc_id").strip()))
def _(t: Tables) -> DataFrame:
    return _alpha_out(agreement.krippendorff(t.ratings(), ["doc_id"], "about", [True, False]))


@plan("g6_alpha_per_year", "G6", sql("ratings", "WITH " + alpha_sql(f"SELECT year, {_COUNTS} FROM ratings GROUP BY year, doc_id", "year").strip()))
def _(t: Tables) -> DataFrame:
    return _alpha_out(agreement.krippendorff(t.ratings(), ["doc_id"], "about", [True, False], ["year"]))


@plan("g7_kappa_per_theme", "G7 N8", sql("theme_pairs theme_rows category_words", "WITH " + fleiss_sql("""
    SELECT category AS theme, CAST(count(r.theme) AS DOUBLE) AS y, CAST(count(*) - count(r.theme) AS DOUBLE) AS n
    FROM theme_pairs p CROSS JOIN category_words c LEFT JOIN theme_rows r
      ON r.doc_id = p.doc_id AND r.rater = p.rater AND r.theme = c.category GROUP BY category, p.doc_id""", "theme").strip()))
def _(t: Tables) -> DataFrame:
    rows = reshape.explode_labels(t.themes(), "themes", "theme", keep_empty=True)
    shown = reshape.presence(rows, ["doc_id"], "rater", "theme", CATEGORIES)
    return _fleiss_out(agreement.fleiss_available(shown, ["doc_id"], "present", [1, 0], ["theme"]))


def _panel(t: Tables) -> DataFrame:
    human = t.human().select("doc_id", F.col("coder").alias("rater"), (F.col("is_political") == 1).alias("about"))
    model = relational.keep_keys(t.ratings().select("doc_id", "rater", "about"), t.raw("labels"), ["doc_id"])
    return human.unionByName(model)


_PANEL_SQL = f"""
    panel_rows AS (SELECT doc_id, rater, about FROM ratings WHERE doc_id IN (SELECT doc_id FROM human)
                   UNION ALL SELECT doc_id, coder, is_political = 1 FROM human),
    tagged AS (SELECT 'all' AS panel, * FROM panel_rows UNION ALL
               SELECT 'subset', * FROM panel_rows WHERE rater NOT LIKE 'coder%'),
    pc AS (SELECT panel, {_COUNTS} FROM tagged GROUP BY panel, doc_id),
    whole AS (SELECT panel, y, n, y + n AS r FROM pc WHERE y + n = CASE WHEN panel = 'all' THEN 11 ELSE 9 END),
    agreed AS (SELECT panel, avg((y * y + n * n - r) / (r * (r - 1))) AS po, pow(sum(y) / sum(r), 2) + pow(sum(n) / sum(r), 2) AS pe
               FROM whole GROUP BY panel),
    kap AS (SELECT panel, round((po - pe) / nullif(1 - pe, 0), 8) AS kappa FROM agreed),
    alp AS (WITH {alpha_sql("SELECT * FROM pc", "panel").strip()})"""


@plan("g8_with_and_without_coders", "G8 J9", sql("ratings human", f"""
    WITH {_PANEL_SQL.strip()} SELECT panel, kappa, alpha FROM kap JOIN alp USING (panel)"""))
def _(t: Tables) -> DataFrame:
    out = agreement.with_and_without(_panel(t), ["doc_id"], "rater", "about", RATERS, [*RATERS, "coder_a", "coder_b"], [True, False])
    return _rounded(_rounded(out, 8, "kappa"), 9, "alpha")


@plan("g9_pairwise_correlations", "G9 I1", sql("ratings", """
    SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n,
           round(corr(CAST(a.about AS DOUBLE), CAST(b.about AS DOUBLE)), 8) AS r
    FROM ratings a JOIN ratings b ON a.doc_id = b.doc_id AND a.rater < b.rater
    WHERE a.about IS NOT NULL AND b.about IS NOT NULL GROUP BY a.rater, b.rater"""))
def _(t: Tables) -> DataFrame:
    return _rounded(agreement.correlations(t.ratings(), ["doc_id"], "rater", "about", RATERS), 8, "r")


@plan("g10_g11_consensus_by_majority", "G10 G11", sql("human ratings", """
    SELECT consensus, count(*) FILTER (WHERE majority) AS machine_yes, count(*) FILTER (WHERE NOT majority) AS machine_no
    FROM (SELECT doc_id, CASE WHEN min(is_political) = 1 THEN 'yes' WHEN max(is_political) = 0 THEN 'no' ELSE 'disagree' END AS consensus
          FROM human GROUP BY doc_id)
    JOIN (SELECT doc_id, count(*) FILTER (WHERE about) > 4.5 AS majority FROM ratings GROUP BY doc_id) USING (doc_id)
    GROUP BY consensus"""))
def _(t: Tables) -> DataFrame:
    agreed = agreement.consensus(t.human().withColumn("flag", F.col("is_political") == 1), "doc_id", "flag", 2)
    majority = t.ratings().groupBy("doc_id").agg((F.count_if("about") > len(RATERS) / 2).alias("majority"))
    joined = agreed.join(majority, "doc_id")
    return aggregate.contingency(joined, "consensus", "majority", {True: "machine_yes", False: "machine_no"})


@plan("g12_disagreement_examples", "G12 T6 M3", sql("human ratings docs", rf"""
    WITH h AS (SELECT doc_id, min(is_political) AS low, max(is_political) AS high FROM human GROUP BY doc_id),
    v AS (SELECT doc_id, count(*) FILTER (WHERE about) AS votes FROM ratings GROUP BY doc_id),
    x AS (SELECT doc_id, CASE WHEN low = 1 AND votes = 0 THEN 'humans only' WHEN high = 0 AND votes > 4.5 THEN 'machines only' END AS kind
          FROM h JOIN v USING (doc_id)),
    picked AS (SELECT * FROM x WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {md5_order('doc_id', 14850)}, doc_id) <= 3),
    cells AS (SELECT kind, doc_id, trim(regexp_replace(regexp_replace(replace(text, '|', '/'), '[\r\n]+', ' / ', 'g'), '\s+', ' ', 'g')) AS c
              FROM picked JOIN docs USING (doc_id))
    SELECT kind, doc_id, CASE WHEN length(c) > 300 THEN left(c, 297) || '...' ELSE c END AS cell FROM cells"""))
def _(t: Tables) -> DataFrame:
    agreed = agreement.consensus(t.human().withColumn("flag", F.col("is_political") == 1), "doc_id", "flag", 2)
    votes = t.ratings().groupBy("doc_id").agg(F.count_if("about").alias("votes"))
    kind = F.when((F.col("consensus") == "yes") & (F.col("votes") == 0), "humans only").when(
        (F.col("consensus") == "no") & (F.col("votes") > len(RATERS) / 2), "machines only"
    )
    found = agreed.join(votes, "doc_id").withColumn("kind", kind).where(F.col("kind").isNotNull())
    picked = sample.per_group(found.select("kind", "doc_id"), ["kind"], "doc_id", 3, 14850)
    shown = t.docs().select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most three rows of two kinds
    return shown.select("kind", "doc_id", text.truncate(text.table_cell(F.col("text")), 300).alias("cell"))


@plan("g12_disagreement_reasons", "G12 N2", sql("human ratings reasoned docs", rf"""
    WITH h AS (SELECT doc_id, min(is_political) AS low, max(is_political) AS high FROM human GROUP BY doc_id),
    v AS (SELECT doc_id, count(*) FILTER (WHERE about) AS votes FROM ratings GROUP BY doc_id),
    x AS (SELECT doc_id, votes, CASE WHEN low = 1 AND votes = 0 THEN 'humans only' WHEN high = 0 AND votes > 4.5 THEN 'machines only' END AS kind
          FROM h JOIN v USING (doc_id)),
    picked AS (SELECT * FROM x WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {md5_order('doc_id', 14850)}, doc_id) <= 5),
    cells AS (SELECT p.*, trim(regexp_replace(regexp_replace(replace(text, '|', '/'), '[\r\n]+', ' / ', 'g'), '\s+', ' ', 'g')) AS c FROM picked p JOIN docs USING (doc_id))
    SELECT kind, doc_id, votes, CASE WHEN length(c) > 150 THEN left(c, 147) || '...' ELSE c END AS cell,
           max(reason) FILTER (WHERE rater = 'coder_a') AS reason_coder_a, max(reason) FILTER (WHERE rater = 'coder_b') AS reason_coder_b,
           max(reason) FILTER (WHERE rater = 'rater_1') AS reason_rater_1
    FROM cells LEFT JOIN reasoned USING (doc_id) GROUP BY kind, doc_id, votes, c"""))
def _(t: Tables) -> DataFrame:
    agreed = agreement.consensus(t.human().withColumn("flag", F.col("is_political") == 1), "doc_id", "flag", 2)
    votes = t.ratings().groupBy("doc_id").agg(F.count_if("about").alias("votes"))
    kind = F.when((F.col("consensus") == "yes") & (F.col("votes") == 0), "humans only").when(
        (F.col("consensus") == "no") & (F.col("votes") > len(RATERS) / 2), "machines only"
    )
    found = agreed.join(votes, "doc_id").withColumn("kind", kind).where(F.col("kind").isNotNull())
    picked = materialize(sample.per_group(found.select("kind", "doc_id", "votes"), ["kind"], "doc_id", 5, 14850), "picked")
    shown = t.docs().select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most five rows of two kinds
    cells = shown.select("kind", "doc_id", "votes", text.truncate(text.table_cell(F.col("text")), 150).alias("cell"))
    return agreement.with_reasons(cells, t.reasoned(), ["doc_id"], "rater", "reason", [*CODERS, "rater_1"])


@plan("g13_single_voter_reasons", "G13 W4 N2", sql("ratings reasoned", """
    WITH one AS (SELECT doc_id, rater AS voter FROM (SELECT *, sum(CAST(about AS INTEGER)) OVER w AS votes, count(about) OVER w AS given,
                        count(*) OVER w AS n FROM ratings WINDOW w AS (PARTITION BY doc_id)) WHERE votes = 1 AND given = n AND about)
    SELECT o.doc_id, voter, v.reason AS voter_reason, b.reason AS baseline_reason FROM one o JOIN reasoned v ON v.doc_id = o.doc_id AND v.rater = voter
    JOIN reasoned b ON b.doc_id = o.doc_id AND b.rater = 'rater_5' WHERE voter <> 'rater_5'"""))
def _(t: Tables) -> DataFrame:
    machines = t.reasoned().where(F.col("rater").isin(RATERS))
    return agreement.lone_voters(machines, "doc_id", "rater", "about", "reason", "rater_5")


@plan("g18_reasons_of_an_item", "G18 N3", sql("reasoned", """
    SELECT doc_id, rater, about, reason FROM reasoned WHERE doc_id = (SELECT min(doc_id) FROM reasoned WHERE rater = 'coder_b' AND about)"""))
def _(t: Tables) -> DataFrame:
    rows = t.reasoned()
    picked = rows.where((F.col("rater") == "coder_b") & F.col("about")).agg(F.min("doc_id").alias("doc_id"))
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "rater", "about", "reason")  # one row


@plan("g14_confidence_by_votes", "G14", sql("human ratings", """
    SELECT is_political, votes, count(*) AS n, round(avg(h.confidence), 9) AS confidence FROM human h
    JOIN (SELECT doc_id, count(*) FILTER (WHERE about) AS votes FROM ratings GROUP BY doc_id) USING (doc_id) GROUP BY is_political, votes"""))
def _(t: Tables) -> DataFrame:
    votes = t.ratings().groupBy("doc_id").agg(F.count_if("about").alias("votes"))
    joined = t.human().join(votes, "doc_id")
    return joined.groupBy("is_political", "votes").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("confidence")
    )


# engines upper-case letters outside ASCII differently, so only these are re-cased
LETTERS = (string.ascii_lowercase, string.ascii_uppercase)


def known_items(t: Tables) -> DataFrame:
    """A curated list: the first document of each source, its heading re-cased and re-punctuated."""
    docs = t.headings().join(t.docs().select("doc_id", "source"), "doc_id")
    first = dedupe.first_per_key(docs.select("source", "doc_id", "title"), ["source"], ["doc_id"])
    shouted = F.concat(F.translate(F.replace("title", F.lit(" "), F.lit(" - ")), *LETTERS), F.lit("?!"))
    return first.select("source", shouted.alias("title"), text.join_key(shouted).alias("title_key"))


KNOWN_SQL = f"""
    first_docs AS (SELECT source, translate(replace(split_part(text, '.', 1), ' ', ' - '), '{LETTERS[0]}', '{LETTERS[1]}') || '?!' AS title FROM docs
                   QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
    known AS (SELECT source, title, {join_key('title')} AS title_key FROM first_docs),
    keyed AS (SELECT doc_id, source, {join_key("split_part(text, '.', 1)")} AS title_key FROM docs)"""


@plan("g16_known_item_labels", "G16 N1", sql("docs ratings", f"""
    WITH {KNOWN_SQL.strip()},
    item AS (SELECT source, title_key, min(doc_id) AS doc_id FROM keyed GROUP BY source, title_key)
    SELECT k.source, k.title_key, i.doc_id, CAST(count(*) FILTER (WHERE about) AS INTEGER) AS votes,
           round(count(*) FILTER (WHERE about) / 9e0, 9) AS share, bool_or(about) FILTER (WHERE rater = 'rater_1') AS about_rater_1,
           bool_or(about) FILTER (WHERE rater = 'rater_9') AS about_rater_9
    FROM known k LEFT JOIN item i ON k.source = i.source AND k.title_key = i.title_key LEFT JOIN ratings r ON r.doc_id = i.doc_id
    GROUP BY k.source, k.title_key, i.doc_id"""))
def _(t: Tables) -> DataFrame:
    keyed = t.headings().join(t.docs().select("doc_id", "source"), "doc_id")
    keyed = keyed.select("source", text.join_key(F.col("title")).alias("title_key"), "doc_id")
    items = dedupe.first_per_key(keyed, ["source", "title_key"], ["doc_id"])
    wide = reshape.wide(t.ratings(), ["doc_id"], "rater", ["about"], RATERS)
    joined = known_items(t).join(items, ["source", "title_key"], "left").join(wide, "doc_id", "left")
    votes = aggregate.count_true([F.col(f"about_{r}") for r in RATERS])
    return joined.select(
        "source", "title_key", "doc_id", votes.alias("votes"), F.round(votes / F.lit(9.0), 9).alias("share"),
        "about_rater_1", "about_rater_9",
    )


@plan("g17_variant_items", "G17", sql("docs ratings", f"""
    WITH {KNOWN_SQL.strip()},
    other AS (SELECT d.doc_id, d.source, d.title_key FROM keyed d
              WHERE d.title_key IN (SELECT title_key FROM known) AND (d.source, d.title_key) NOT IN (SELECT source, title_key FROM known))
    SELECT o.doc_id, o.source, CAST(count(*) FILTER (WHERE about) AS BIGINT) AS votes
    FROM other o JOIN ratings r ON r.doc_id = o.doc_id GROUP BY o.doc_id, o.source"""))
def _(t: Tables) -> DataFrame:
    keyed = t.headings().join(t.docs().select("doc_id", "source"), "doc_id")
    keyed = keyed.select("doc_id", "source", text.join_key(F.col("title")).alias("title_key"))
    known = known_items(t)
    same_title = keyed.join(known.select("title_key").distinct(), "title_key", "left_semi")
    # as NOT IN decides: what an unknown source or title could be equal to is left out
    other = same_title.where(F.col("source").isNotNull()).join(known, ["source", "title_key"], "left_anti")
    other = other.join(known.where(F.col("title_key").isNull()), "source", "left_anti")
    nameless = F.broadcast(known.where(F.col("source").isNull()).select(F.col("title_key").alias("_k")))  # one row at most
    other = other.join(nameless, F.col("_k").isNull() | (F.col("_k") == F.col("title_key")), "left_anti")
    votes = t.ratings().groupBy("doc_id").agg(F.count_if("about").alias("votes"))
    return other.join(votes, "doc_id").select("doc_id", "source", "votes")


@plan("g18_values_of_items_by_rater", "G18 N3", sql("ratings", """
    SELECT doc_id, rater, confidence FROM ratings WHERE doc_id IN (
        SELECT doc_id FROM ratings GROUP BY doc_id HAVING count(*) FILTER (WHERE about) = 9)"""))
def _(t: Tables) -> DataFrame:
    wide = reshape.wide(t.ratings(), ["doc_id"], "rater", ["about", "confidence"], RATERS)
    agreed = wide.where(aggregate.all_same([F.col(f"about_{r}") for r in RATERS], True))
    long = reshape.long(agreed, ["doc_id"], [f"confidence_{r}" for r in RATERS], "name", "confidence")
    return long.select("doc_id", F.regexp_replace("name", "^confidence_", "").alias("rater"), "confidence")


@plan("g19_profile_distances", "G19 N9", sql("theme_rows category_words", """
    WITH p AS (SELECT rater, theme, mean FROM (""" + PROFILE_SQL.replace("rater, category AS theme", "p.rater, category AS theme").replace("GROUP BY rater", "GROUP BY p.rater") + """))
    SELECT a.rater AS rater_a, b.rater AS rater_b, round(sqrt(sum(pow(a.mean - b.mean, 2))), 9) AS distance
    FROM p a JOIN p b ON a.theme = b.theme AND a.rater < b.rater GROUP BY a.rater, b.rater"""))
def _(t: Tables) -> DataFrame:
    return _rounded(agreement.profile_distances(profiles(t), "theme", "rater", "mean", RATERS[:8]), 9, "distance")
