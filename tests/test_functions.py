"""Text, HTML, stems and statistics on hand-worked cases."""

import math

import pytest
from annolytics.functions import stats, text
from annolytics.functions.html import LYRIC_PAGE, page_text
from annolytics.functions.stem import stem_word
from pyspark.sql import functions as F


def values(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def test_clean_and_key(spark):
    assert values(spark, text.clean_text(F.col("x")), ["Don't!", None, "Ünï 9"]) == ["don t ", "", "ünï 9"]
    assert values(spark, text.join_key(F.col("x")), ["  What's -- Going on?", None, "///"]) == ["what s going on", None, ""]


def test_match_text(spark):
    got = values(spark, text.match_text(F.col("x")), [
        "A & B feat. C (Remix) [Live]", "Featuring Him", "Soft ft X", "café", "(all)", "left feature",
    ])
    assert got == ["a and b c", "him", "soft x", "caf", "", "left feature"]


def test_edit_score(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd"), ("abc", "")], "a string, b string")
    got = [r[0] for r in df.select(text.edit_score(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, pytest.approx(1 / 3), 1.0]


def test_keywords_need_whole_words(spark):
    df = spark.createDataFrame([("Political wars; they VOTE",), ("warm polities, afghans",)], "x string")
    rows = df.select(text.clean_text(F.col("x")).alias("c")).select(*text.keyword_flags(F.col("c"))).collect()
    assert [k for k, v in rows[0].asDict().items() if v] == ["keyword_politics", "keyword_war", "keyword_vote"]
    assert [k for k, v in rows[1].asDict().items() if v] == ["keyword_afghanistan"]


def test_ngrams(spark):
    words = text.tokens(F.col("x"))
    assert values(spark, text.ngrams(words, 2), ["a b c", "a", ""]) == [["a b", "b c"], [], []]
    assert values(spark, text.ngrams(words, 3), ["a b c d", "a b"]) == [["a b c", "b c d"], []]


def test_template_values_are_not_searched_again(spark):
    df = spark.createDataFrame([("{{b}}", "z")], "a string, b string")
    out = df.select(text.render_template('{{a}}-{{ b }} \\{"k"\\}', {"a": F.col("a"), "b": F.col("b")})).first()[0]
    assert out == '{{b}}-z {"k"}'
    with pytest.raises(KeyError):
        text.render_template("{{missing}}", {})


def test_cells_and_truncation(spark):
    assert values(spark, text.table_cell(F.col("x")), ["a|b\r\n\nc   d "]) == ["a/b / c d"]
    assert values(spark, text.truncate(F.col("x"), 5), ["abcdef", "abcde", None]) == ["ab...", "abcde", None]


def test_snake_names():
    assert text.snake_names(["Song Title", "song_title", "RankNo", "100%", "#"]) == [
        "song_title", "song_title_2", "rank_no", "x100_percent", "number",
    ]


def test_stems():
    words = ["caresses", "ponies", "cats", "agreed", "plastered", "motoring", "hopping", "falling", "sky", "happy",
             "relational", "conditional", "triplicate", "hopeful", "goodness", "revival", "adjustment", "adoption",
             "probate", "controlling", "city", "welcome", "at"]
    assert [stem_word(w) for w in words] == [
        "caress", "poni", "cat", "agre", "plaster", "motor", "hop", "fall", "sky", "happi", "relat", "condit", "triplic",
        "hope", "good", "reviv", "adjust", "adopt", "probat", "control", "citi", "welcom", "at",
    ]


def test_stems_of_the_english_rules():
    words = "boy day play way stay hey money eye one cry by ties cries gas this generously communism knightly hoping skies inning"
    stems = "boy day play way stay hey money eye one cri by tie cri gas this generous communism knight hope sky inning"
    assert [stem_word(w) for w in words.split()] == stems.split()


PAGE = """<html><script>var a="<div data-lyrics-container='true'>no</div>"</script>
<div data-lyrics-container="true"><div class="LyricsHeader__x">Head</div>One &amp; two<br>  three<br><br><br>four
<script>x()</script><b>bo<i>ld</i></b></div><p>outside</p><div data-lyrics-container="true">second</div></html>"""


def test_page_text(spark):
    pages = [PAGE, "<div class='song lyrics'>fall<br/>back</div>", "<p>nothing</p>", "<div data-lyrics-container='true'> <br> </div>", None]
    got = values(spark, page_text(F.col("x"), LYRIC_PAGE), pages)
    assert got == ["One & two\nthree\n\nfour\nbold\nsecond", "fall\nback", None, None, None]


def test_two_sided_p(spark):
    got = values(spark, stats.two_sided_p(F.col("x")), [0.0, 1.96, -2.5758], "x double")
    for z, p in zip([0.0, 1.96, 2.5758], got, strict=True):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_t_quantile(spark):
    got = values(spark, stats.t_975(F.col("x")), [10.0, 30.0, 1e9], "x double")
    assert got == [pytest.approx(2.228139, abs=2e-4), pytest.approx(2.042272, abs=1e-5), pytest.approx(1.959964, abs=1e-6)]


def test_weighted_mean_null_rules(spark):
    df = spark.createDataFrame(
        [("a", True, 0.5), ("a", None, None), ("a", False, 0.5), ("b", True, None), ("b", True, 1.0), ("c", None, 1.0), ("d", True, 0.0)],
        "g string, x boolean, w double",
    )
    out = df.groupBy("g").agg(stats.weighted_mean(F.col("x").cast("double"), F.col("w")).alias("m"))
    assert {r.g: r.m for r in out.collect()} == {"a": 0.5, "b": None, "c": None, "d": None}
