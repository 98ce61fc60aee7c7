"""Page differencing: blocks, alignment, pairs, and the registered query against SQL-like extraction."""

import html
import re

import pytest
from annolytics.llm import page_diff
from annolytics.llm.queries import QUERIES
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st


def text_of(page, partner=None):
    return page_diff.main_text(page_diff.lines(page), page_diff.lines(partner) if partner is not None else None)


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("<", "<"), ("a < b &amp; c&nbsp;&#228;", "a < b & c ä"),
    ("<body><nav>Menu</nav><article><h1>T &lt;x&gt;</h1><p>One\n  two<b> three</b>four<br>five<p>six</article><footer>F</footer>", "T <x>\nOne two threefour\nfive\nsix"),
    ("<header>H</header><main><header><h1>Title</h1></header>text<aside>side</aside>more</main>end", "Title\ntext\nmore"),
    ("<article>a<div class='ad'>buy</div><div id=comments><article>reader</article></div><p class=\"lead\">b</p></article>", "a\nb"),
    ("<article>x<script>var t='</p><article>';</script><style>p{}</style><!-- c <p> -->y<form>f<input value='>'>g</form></article>", "xy"),
    ("<article>never <b>closed<footer>foot", "never closed"),
    ("<div class='article-header'>head</div><div class='entry-content'>in</div>", "in"),
    ("<p title='a>b'>quoted</p><div role=navigation>nav</div><div class=cookie-notice>ok?</div>", "quoted"),
])
def test_single_pages(page, want):
    assert text_of(page) == want


def test_shared_lines_go_where_no_article_is_marked():
    a = "<div>Site name</div><div>own words here</div><div>All rights</div>"
    b = "<div>Site name</div><div>other words</div><div>and more</div><div>All rights</div>"
    assert text_of(a, b) == "own words here" and text_of(b, a) == "other words\nand more"
    quoted = "<div>Site name</div><article>own <p>quotation</p></article>"
    assert text_of(quoted, "<div>Site name</div><article><p>quotation</p></article>") == "own\nquotation"


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=300, deadline=None)
def test_alignment_is_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    places = sorted(page_diff.shared_places(a, b))
    assert len(places) == table[-1][-1]
    rest = iter(b)
    assert all(a[i] in rest for i in places)


def test_pairs_and_defined_cases(spark):
    page = "<div>Common top</div><div>{}</div>"
    rows = [(i, f"http://H.example/a/{i:03d}?q={i}", page.format(f"text {i}")) for i in range(200)]
    rows += [(500, None, page.format("no url")), (501, "http://other.example/", page.format("alone")), (502, "not a url", None), (None, "", "")]
    rows += [(7, "http://H.example/a/007?q=7", page.format("text 7"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as _key", "3 as _slice")
    got = {(r.page_id, r.url): r for r in page_diff.extract(df).collect()}
    assert page_diff.extract(df).count() == len(rows)
    for i in range(1, 200):
        text = got[(i, f"http://H.example/a/{i:03d}?q={i}")].text
        assert text == f"text {i}" or i == 7 and text in ("text 7", "")
    assert got[(0, "http://H.example/a/000?q=0")].text == "Common top\ntext 0"  # the last of its host has no partner
    assert got[(500, None)].text == "Common top\nno url" and got[(501, "http://other.example/")].text == "Common top\nalone"
    assert got[(502, "not a url")].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert page_diff.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(("page", "want"), [
    ("<html class=has-menu><body class='no-sidebar'><nav>n</nav><article>a<p>b</article>", "a\nb"),
    ("<body class='sidebar'><p>no article</p>", "no article"),
    ("<div id='page-with-sidebar'><div class=sidebar>s</div><article class='post category-social'>a</article></div>", "a"),
    ("<div class='page-header'>h<article>a</article></div>", "a"), ("<div class='banner'><main>m</main></div>", "m"),
    ("<div class='with-menu'><div class='entry-content'>a</div></div>", "a"),
    ("<div class='no-share'><nav>n<article>teaser</article></nav></div><article>a</article>", "a"),
    ("<article>a</article><div class=related><article>other</article></div><div class=ad-box>x</div>", "a"),
    ("<article>a<div class='post-comments'><article>reader</article></div></article>", "a"),
])
def test_class_parts_do_not_drop_what_holds_the_article(page, want):
    assert text_of(page) == want


def test_differencing_decides_outside_the_article():
    page = "<div>Site name</div><article>{0}</article><div>Fig. {0}</div><div>All rights</div>"
    assert text_of(page.format("one"), page.format("two")) == "one\nFig. one"
    assert text_of(page.format("one")) == "one"


def test_last_page_of_a_host_takes_the_one_before(spark):
    """Many hosts of one to five pages, so that slices begin at every place of a host; and one of 300 pages."""
    page = "<div>Top of {0}</div><div>text {1}</div>"
    hosts = [(f"h{n}.example", n % 5 + 1) for n in range(120)] + [("long.example", 300)]
    rows = [(n * 1000 + i, f"http://{h}/{i:03d}", page.format(h, i)) for n, (h, size) in enumerate(hosts) for i in range(size)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    sizes, got = dict(hosts), page_diff.extract(df, turn_back=True).collect()
    assert len(got) == len(rows)
    for r in got:
        host, i = r.url.split("/")[2], int(r.url[-3:])
        assert r.text == (f"text {i}" if sizes[host] > 1 else f"Top of {host}\ntext {i}")


def test_query_gives_the_marked_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op4_page_differencing"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.url == pages[r.page_id].url
