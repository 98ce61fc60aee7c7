"""Text expressions. All of them run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight keyword searches, as patterns over cleaned text (words parted by blanks).
KEYWORD_PATTERNS = {
    "politics": "(^| )politic(s|al)( |$)",
    "war": "(^| )war(s)?( |$)",
    "democracy": "democra",
    "vote": "(^| )(vote|voting)( |$)",
    "korea": "(^| )korea( |$)",
    "vietnam": "(^| )vietnam( |$)",
    "iraq": "(^| )iraq( |$)",
    "afghanistan": "(^| )afghan",
}


def clean_text(col: Column) -> Column:
    """Lower case, with every character that is no letter or digit turned into one blank."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]", " ")


def join_key(col: Column) -> Column:
    """Lower case, runs of other characters to one blank, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def match_text(col: Column) -> Column:
    """Normal form for edit distance: ASCII words without guest-artist markers and bracketed parts."""
    x = F.replace(F.lower(col), F.lit("&"), F.lit("and"))
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])(?:feat|featuring|ft)(?![\p{L}\p{N}_])", "")
    x = F.regexp_replace(x, r"(?s)\(.*?\)|\[.*?\]", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def edit_score(a: Column, b: Column) -> Column:
    """Edit distance over the longer length (at least one)."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")


def keyword_flags(cleaned: Column, patterns: Mapping[str, str] = KEYWORD_PATTERNS) -> list[Column]:
    """One boolean per pattern, all in one projection over the cleaned text."""
    return [cleaned.rlike(pattern).alias(f"keyword_{name}") for name, pattern in patterns.items()]


def tokens(cleaned: Column) -> Column:
    """Words of a cleaned text, empty pieces dropped."""
    return F.filter(F.split(cleaned, " +"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Blank-joined runs of ``n`` neighbouring words."""
    out = words
    for k in range(2, n + 1):
        later = F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(0)))
        out = F.filter(F.zip_with(out, later, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    return out


def table_cell(col: Column) -> Column:
    """Make text safe for one table cell: bars to slashes, line breaks to `` / ``, blanks squeezed."""
    x = F.replace(col, F.lit("|"), F.lit("/"))
    x = F.regexp_replace(x, r"[\r\n]+", " / ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def truncate(col: Column, width: int, ellipsis: str = "...") -> Column:
    keep = width - len(ellipsis)
    return F.when(F.length(col) > width, F.concat(F.left(col, F.lit(keep)), F.lit(ellipsis))).otherwise(col)


def has_text(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def mask_listed(col: Column, listed: Sequence[str]) -> Column:
    """Keep the first letter of a listed word and star the rest; other words pass."""
    starred = F.concat(F.left(col, F.lit(1)), F.repeat(F.lit("*"), F.length(col) - 1))
    return F.when(F.lower(col).isin([w.lower() for w in listed]), starred).otherwise(col)


def render_template(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill ``{{name}}`` slots; ``\\{`` stands for a plain brace.

    The template is cut up once on the driver, so slot values are never searched for further slots.
    """
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\{\s*(\w+)\s*\}\}", template)):
        if i % 2:
            if piece not in slots:
                raise KeyError(f"template slot {piece!r} has no value")
            parts.append(slots[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece.replace("\\{", "{").replace("\\}", "}")))
    return F.concat(*parts)


def digest(col: Column) -> Column:
    """Row key of a text: its MD5 in hex."""
    return F.md5(col.cast("binary"))


def seeded_order(id_col: Column, seed: int | str) -> Column:
    """Repeatable shuffle key: MD5 of id and seed, the same on every engine and layout."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(str(seed))).cast("binary"))


def snake_names(names: Sequence[str]) -> list[str]:
    """Lower snake case column names; repeats get a numeric suffix."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", "_percent_").replace("#", "_number_"))
        base = re.sub(r"[^0-9A-Za-z]+", "_", base).strip("_").lower() or "x"
        if base[0].isdigit():
            base = "x" + base
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out
