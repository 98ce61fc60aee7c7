"""Common table expressions of the stand-in tables, for DuckDB."""

from __future__ import annotations

from annolytics.sources import standins

CLEAN = r"regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]', ' ', 'g')"
JOIN_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
MATCH = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '&', 'and'), "
    r"'(^|[^\p{{L}}\p{{N}}_])(feat|featuring|ft)($|[^\p{{L}}\p{{N}}_])', '\1\3', 'g'), "
    r"'(?s)\(.*?\)|\[.*?\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
)


def clean(x: str) -> str:
    return CLEAN.format(x)


def join_key(x: str) -> str:
    return JOIN_KEY.format(x)


def match(x: str) -> str:
    return MATCH.format(x)


def words(x: str) -> str:
    return f"list_filter(string_split_regex({clean(x)}, ' +'), lambda w: w <> '')"


def md5_order(x: str, seed: int) -> str:
    return f"md5(CAST({x} AS VARCHAR) || '{seed}')"


def _values(rows) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"{v!r}e0"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


CTES = {
    "docs": ((), "SELECT doc_id, text, lang, source, n_chars, CAST(1958 + doc_id % 68 AS INTEGER) AS year FROM documents"),
    "chart": ((), "SELECT l_partkey AS song, l_suppkey AS artist, l_linenumber AS rank, l_shipdate AS date FROM lineitem"),
    "rules": ((), f"SELECT * FROM (VALUES {_values(standins.RATER_CUTS)}) AS v(rater, k, cut)"),
    "raw_ratings": (
        ("docs", "rules"),
        """
        SELECT doc_id, year, rater, seq,
               CASE WHEN (doc_id + k) % 23 <> 0 THEN
                    CASE WHEN seq = 1 THEN density > cut ELSE NOT (density > cut) END END AS about,
               5e-1 + CAST((doc_id * 31 + k * 17) % 50 AS DOUBLE) / 1e2 AS confidence
        FROM (SELECT doc_id, year,
                     1e2 * (CAST(length(lower(text)) - length(replace(lower(text), 'th', '')) AS DOUBLE) / 2e0)
                         / CAST(length(text) AS DOUBLE) AS density
              FROM docs) d
        CROSS JOIN rules
        JOIN (VALUES (1), (2)) AS s(seq) ON seq = 1 OR doc_id % 50 = 0
        """,
    ),
    "ratings": (
        ("raw_ratings",),
        "SELECT * EXCLUDE (seq) FROM raw_ratings QUALIFY row_number() OVER (PARTITION BY doc_id, rater ORDER BY seq) = 1",
    ),
    "noisy": (
        ("ratings", "rules"),
        """
        SELECT doc_id, year, rater, confidence,
               CASE WHEN ((doc_id % 1000003) * 7919 + k * 104729) % 1000003 % 8 = 0 THEN NOT about ELSE about END AS about
        FROM ratings JOIN rules USING (rater)
        """,
    ),
    "human": (
        ("docs",),
        """
        SELECT doc_id, year, coder, is_political,
               5e-1 + CAST((doc_id * 31 + turn * 17) % 50 AS DOUBLE) / 1e2 AS confidence
        FROM (SELECT doc_id, 'coder_a' AS coder, 1 AS turn, quality AS is_political FROM labels
              UNION ALL SELECT doc_id, 'coder_b', 2, toxic FROM labels) l JOIN docs USING (doc_id)
        """,
    ),
    "reasoned": (
        ("ratings", "human"),
        """
        SELECT *, rater || ' says ' || coalesce(CAST(about AS VARCHAR), 'nothing') || ' of ' || doc_id AS reason
        FROM (SELECT doc_id, rater, about FROM ratings UNION ALL SELECT doc_id, coder, is_political = 1 FROM human)
        """,
    ),
    "category_words": ((), f"SELECT * FROM (VALUES {_values([(i, c, w) for i, (c, w) in enumerate(standins.CATEGORY_WORDS)])}) AS v(i, category, word)"),
    "theme_rows": (
        ("docs", "category_words", "rules"),
        f"""
        SELECT doc_id, year, rater, category AS theme, i
        FROM (SELECT doc_id, year, i, category,
                     len(list_filter(w, lambda x: x = word)) AS n
              FROM (SELECT doc_id, year, string_split({clean('text')}, ' ') AS w FROM docs) CROSS JOIN category_words)
        CROSS JOIN (SELECT rater, k FROM rules WHERE k <= 8)
        WHERE n >= 1 + (k * 5 + i) % 4
        QUALIFY row_number() OVER (PARTITION BY doc_id, rater ORDER BY i) <= 4
        """,
    ),
    "theme_pairs": (("docs", "rules"), "SELECT doc_id, year, rater FROM docs CROSS JOIN rules WHERE k <= 8"),
    "usage": (
        (),
        """
        SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'batch' ELSE 'sequential' END AS processing,
               value * 1e2 AS input_tokens, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cached_input_tokens,
               value * 1e1 AS output_tokens,
               CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 0e0
                    WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0e0 ELSE value / 1e3 END AS cost
        FROM events
        """,
    ),
    "prices": (
        (),
        f"SELECT * FROM (VALUES {_values(standins.USAGE_PRICES)}) AS v(model, input_per_m, output_per_m, "
        "cached_input_per_m, batch_discount_factor, cache_discounts_with_batch)",
    ),
    "headings": (
        ("docs",),
        f"SELECT doc_id, year, split_part(text, '.', 1) AS title, {match(chr(39).join(['split_part(text, ', '.', ', 1)']))} AS key FROM docs",
    ),
    "catalogue": (
        (),
        f"SELECT page_id AS cand_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url, "
        f"{match('regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1)')} AS key FROM pages",
    ),
    "reasons": ((), "SELECT conv_id, turn, role AS coder, text FROM conversations"),
    "lexicon": ((), f"SELECT * FROM (VALUES {_values(standins.LEXICON)}) AS v(category, term)"),
}


def sql(needs: str, body: str) -> str:
    """``body`` behind the named CTEs and those they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{name} AS ({CTES[name][1].strip()})" for name in order)
    extra = body.strip()
    if extra.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{extra[15:]}" if order else extra
    if extra.upper().startswith("WITH "):
        return f"WITH {head},\n{extra[5:]}" if order else extra
    return f"WITH {head}\n{extra}" if order else extra
