"""Main text of web pages by nearest-URL page differencing.

Pages stand in order of host and URL path; each is paired with the next page of its host, the one nearest by path. The
text lines of both are aligned by their longest common subsequence, and lines that the pair shares are template: they
go. Differencing by itself is wrong in both directions on pages of one host: a quotation, a mirrored article or an
often repeated paragraph is shared without being template, and a footer with a changing line is template without being
shared. So it decides about all lines whose place in the page does not: lines inside an ``article`` or ``main`` element
stay, and menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles go by their element,
class or id. Of the other lines those stay that the partner does not share, also on a page with an article. Where there
is no partner to decide, they stay on a page without an article and go on a page with one.

Defined cases: null or empty HTML gives the empty text; a page without URL, or the only one of its host, has no partner;
the last of its host has the page before it (``turn_back``) or none; pages with one URL stand in order of their ids;
unclosed elements end with the page; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import text_or_empty
from annolytics.llm.neighbours import with_next

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<|[^<]+", re.S)
RAW = frozenset("script style noscript template iframe textarea svg math object title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
PLACES = frozenset("nav footer aside form head menu select button dialog label".split())
MAIN = frozenset(("article", "main"))
#: Their class says how the whole page looks, not what it is.
ROOTS = frozenset(("html", "body"))
NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TEMPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|cookies?|consent|notice|popup|modal|sidebar|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|comments?|respond|disqus|share|sharing|social|promo|sponsor(?:ed)?|related|newsletter|"
    r"subscribe|widget|masthead|topbar|toolbar|pagination|pager|complementary|contentinfo)(?:$|[\s_-])", re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|banner)(?:$|[\s_-])", re.I)
#: The name as a whole, not one part of it as in ``page-with-sidebar``.
WHOLE = re.compile(TEMPLATE.pattern.replace(r"[\s_-]", r"\s"), re.I)
CONTENT = re.compile(r"(?:^|\s)(?:articlebody|article-body|article-content|post-content|entry-content|main-content)(?:$|\s)", re.I)


def lines(html: str) -> list[tuple[str, str]]:
    """Text blocks in page order, with the place of each: ``article``, ``template`` or ``open``.

    What a class or id makes template is lifted where the element turns out to hold the article: always for a ``main``,
    for others where only a part of the name says so, since whole names such as ``comments`` or ``related`` stand for
    lists of further articles. Inside an article nothing is lifted.
    """
    out: list[tuple[str, tuple[int, ...], bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, number of its template mark or 0, whether it is the article
    marks: list[int] = []  # open template marks
    weak: dict[int, bool] = {}  # marks by class or id outside an article, and whether the whole name says so
    lifted: set[int] = set()
    article = number = 0

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append((text, tuple(marks), article > 0))

    place, size = 0, len(html)
    while place < size and (found := TOKEN.match(html, place)):
        place = found.end()
        name = found[2]
        if name is None:
            piece = found[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
            continue
        name = name.lower()
        if name not in INLINE and name not in RAW:
            end_block()
        if found[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                for element in stack[at:]:
                    if element[1] or element[2]:
                        end_block()
                    if element[1]:
                        marks.remove(element[1])
                    article -= element[2]
                del stack[at:]
            continue
        if name in RAW and not found[3].endswith("/"):
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(html, place)
            place = close.end() if close else size
            continue
        if name in VOID or found[3].endswith("/"):
            continue
        named = " ".join(v.strip("\"'") for _, v in NAMES.findall(found[3])) if "=" in found[3] else ""
        is_article = name in MAIN or bool(named and CONTENT.search(named))
        drop = name in PLACES or name == "header" and not article
        by_name = False
        if named and not drop and name not in MAIN and name not in ROOTS:
            drop = by_name = bool(TEMPLATE.search(named)) or not article and not is_article and bool(HEADER.search(named))
        is_article = is_article and not drop
        if drop or is_article:
            end_block()
        if is_article:
            lifted.update(m for m in marks if m in weak and (name == "main" or not weak[m]))
        if drop:
            number += 1
            marks.append(number)
            if by_name and not article:
                weak[number] = bool(WHOLE.search(named))
        article += is_article
        stack.append((name, number if drop else 0, is_article))
    end_block()
    return [
        (text, "template" if any(m not in lifted for m in within) else "article" if inside else "open")
        for text, within, inside in out
    ]


def shared_places(a: Sequence[str], b: Sequence[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        meet = row & where.get(x, 0)
        row = (row + meet | row - meet) & full
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.add(i)
            j -= 1
    return out


def main_text(own: list[tuple[str, str]], partner: list[tuple[str, str]] | None) -> str:
    """Text of a page, given the lines of the page that is nearest by URL."""
    shared = shared_places([t for t, _ in own], [t for t, _ in partner]) if partner else set()
    has_article = any(kind == "article" for _, kind in own)
    kept = [
        t for i, (t, kind) in enumerate(own)
        if kind == "article" or kind == "open" and i not in shared and (partner is not None or not has_article)
    ]
    return "\n".join(kept)


def extract(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", *, turn_back: bool = False
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; with ``turn_back``, the last page of a host takes the one before."""
    out = df.select(F.col(id_column), F.col(url_column), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    place = F.regexp_extract(url_column, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url_column, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#]*)([^?#]*)", 2)
    host = F.lower(place)
    known = F.col(url_column).isNotNull()
    wanted = df.select(
        F.col(id_column), F.col(url_column), text_or_empty(html_column).alias("_html"), F.when(known, host).alias("_host"),
        F.when(known, F.concat_ws("\x01", host, path, F.lpad(F.coalesce(F.col(id_column).cast("string"), F.lit("")), 20, "0"))).alias("_key"),
    )

    def work(pairs: Iterator[tuple[dict, dict | None]]) -> Iterator[dict]:
        ready: tuple[str | None, list] = (None, [])
        before: tuple[str | None, list] = (None, [])  # host and lines of the page before
        for row, following in pairs:
            own = ready[1] if ready[0] == row["_html"] else lines(row["_html"])
            partner = None
            if following is not None:
                ready = (following["_html"], lines(following["_html"]))
                partner = ready[1] if following["_host"] == row["_host"] else None
            if turn_back and partner is None and row["_host"] is not None and before[0] == row["_host"]:
                partner = before[1]
            before = (row["_host"], own)
            text = main_text(own, partner)
            yield {id_column: row[id_column], url_column: row[url_column], "text": text, "n_chars": len(text)}

    return with_next(wanted, "_key", "_html", work, out, wrap=False, group="_host" if turn_back else None)
