"""Text extraction from page markup, one Arrow batch at a time."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
SILENT_TAGS = frozenset(("script", "style"))


@dataclass(frozen=True)
class Selector:
    """``tag[attr op value]``; op is ``=`` (equal), ``^=`` (prefix) or ``~=`` (word). Empty parts match all."""

    tag: str = ""
    attr: str = ""
    op: str = "="
    value: str = ""

    def hits(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and tag != self.tag:
            return False
        if not self.attr:
            return True
        found = attrs.get(self.attr)
        if found is None:
            return False
        if self.op == "^=":
            return found.startswith(self.value)
        if self.op == "~=":
            return self.value in found.split()
        return found == self.value


@dataclass(frozen=True)
class PageSpec:
    """Container selectors, tried group by group until one group matches, and blocks to leave out."""

    containers: tuple[tuple[Selector, ...], ...]
    drop: tuple[Selector, ...] = ()


# Markup of the lyric pages, first choice, fallbacks and header blocks.
LYRIC_PAGE = PageSpec(
    containers=(
        (Selector("div", "data-lyrics-container", "=", "true"),),
        (Selector("div", "class", "~=", "lyrics"), Selector("div", "class", "^=", "Lyrics__Container")),
    ),
    drop=(
        Selector("", "data-exclude-from-selection", "=", "true"),
        Selector("div", "class", "^=", "LyricsHeader__"),
    ),
)


class _ContainerText(HTMLParser):
    """Collects the text of every outermost element one of ``wanted`` hits."""

    def __init__(self, wanted: tuple[Selector, ...], drop: tuple[Selector, ...]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.drop = wanted, drop
        self.open: list[tuple[str, bool, bool]] = []  # tag, starts a container, is left out
        self.depth = self.hidden = 0
        self.texts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        if tag in VOID_TAGS:
            if tag == "br" and self.depth and not self.hidden:
                self.texts[-1].append("\n")
            return
        starts = not self.hidden and any(s.hits(tag, named) for s in self.wanted)
        hides = self.depth > 0 and (tag in SILENT_TAGS or any(s.hits(tag, named) for s in self.drop))
        if starts:
            if not self.depth:
                self.texts.append([])
            self.depth += 1
        self.hidden += hides
        self.open.append((tag, starts, hides))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(name == tag for name, _, _ in self.open):
            return
        while self.open:
            name, starts, hides = self.open.pop()
            self.depth -= starts
            self.hidden -= hides
            if name == tag:
                return

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.texts[-1].append(data)


def container_texts(html: str | None, spec: PageSpec) -> list[str] | None:
    """Raw text of each container, or None when no selector group matches."""
    if html is None:
        return None
    for group in spec.containers:
        parser = _ContainerText(group, spec.drop)
        parser.feed(html)
        parser.close()
        if parser.texts:
            return ["".join(parts) for parts in parser.texts]
    return None


def page_text(html: Column, spec: PageSpec = LYRIC_PAGE) -> Column:
    """Text of a page: line breaks kept, blanks around them stripped, three or more squeezed; empty is null.

    Python does the markup only; the text work stays in SQL expressions.
    """

    @F.pandas_udf("array<string>")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: container_texts(page, spec))

    def tidy(x: Column) -> Column:
        x = F.replace(x, F.lit("\r\n"), F.lit("\n"))
        return F.regexp_replace(F.regexp_replace(x, "[ \t]+\n", "\n"), "\n[ \t]+", "\n")

    parts = F.filter(F.transform(extract(html), tidy), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    text = F.regexp_replace(F.array_join(parts, "\n"), "\n{2,}", "\n\n")
    text = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(text != "", text)
