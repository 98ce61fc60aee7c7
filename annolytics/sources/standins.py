"""The driver tables seen as chart, corpus, raters, coders, themes, usage and catalogue.

Every stand-in is a lazy view of whole tables, so the work of a registered plan grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators.dedupe import first_per_key
from annolytics.operators.relational import cross_with_dimension
from annolytics.session import spread

# Fixed values of the rule raters: a document is "about" when its count of "th" per 100 characters is above the cut.
RATER_CUTS = [
    ("rater_1", 1, 4.4), ("rater_2", 2, 4.6), ("rater_3", 3, 4.8), ("rater_4", 4, 5.0), ("rater_5", 5, 5.2),
    ("rater_6", 6, 5.3), ("rater_7", 7, 5.4), ("rater_8", 8, 5.5), ("rater_9", 9, 5.7),
]
RATERS = [name for name, _, _ in RATER_CUTS]
CODERS = ["coder_a", "coder_b"]

# The word that stands for each category.
CATEGORY_WORDS = [
    ("Category 1", "the"), ("Category 2", "and"), ("Category 3", "of"), ("Category 4", "that"), ("Category 5", "is"),
    ("Category 6", "la"), ("Category 7", "le"), ("Category 8", "des"), ("Category 9", "der"), ("Category 10", "die"),
    ("Category 11", "que"), ("Category 12", "para"),
]
CATEGORIES = [name for name, _ in CATEGORY_WORDS]

LEXICON = [
    ("politics", "the"), ("politics", "of the"), ("politics", "la"), ("government", "and"), ("government", "der"),
    ("government", "los"), ("violence", "that"), ("violence", "die"), ("violence", "that the"), ("military", "le"),
    ("military", "que"), ("military", "for the"), ("law", "is"), ("law", "it is"), ("law", "des"), ("law", "is"),
    ("terrorism", "zzyzx"), ("independence", "don't"),
]
MEASURES = ["politics", "government", "violence", "military", "law", "terrorism"]

USAGE_PRICES = [
    ("click", 0.4, 2.0, 0.04, 0.6, None), ("view", 0.125, 0.5, 0.0625, 0.5, False),
    ("purchase", 0.25, 0.75, None, 0.8, False), ("error", 1.5, 4.5, 0.75, 0.5, True),
]


def _occurrences(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


class Tables:
    """Lazy access to the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def chart(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("song"), F.col("l_suppkey").alias("artist"), F.col("l_linenumber").alias("rank"),
            F.col("l_shipdate").alias("date"),
        )

    def docs(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", "text", "lang", "source", "n_chars", (1958 + F.col("doc_id") % 68).cast("int").alias("year")
        )

    def raw_ratings(self) -> DataFrame:
        """Nine ratings per document, some missing, some stored twice (``seq`` tells the later one)."""
        lower = F.lower("text")
        hits = (F.length(lower) - F.length(F.replace(lower, F.lit("th"), F.lit("")))) / 2.0
        size = F.length("text").cast("double")
        density = F.when(size == 0, float("nan")).otherwise(F.lit(100.0) * hits / size)  # 0 / 0 as in SQL on doubles: above any cut
        docs = self.docs().select("doc_id", "year", density.alias("density"))
        rules = [{"rater": r, "k": k, "cut": c} for r, k, c in RATER_CUTS]
        crossed = cross_with_dimension(docs, rules, "rater string, k int, cut double")
        about = F.when((F.col("doc_id") + F.col("k")) % 23 != 0, F.col("density") > F.col("cut"))
        confidence = 0.5 + ((F.col("doc_id") * 31 + F.col("k") * 17) % 50).cast("double") / 100.0
        copies = F.when(F.col("doc_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        rated = crossed.select(
            "doc_id", "year", "rater", F.explode(copies).alias("seq"), about.alias("_about"), confidence.alias("confidence")
        )
        flipped = F.when(F.col("seq") == 1, F.col("_about")).otherwise(~F.col("_about"))
        return rated.withColumn("about", flipped).drop("_about")

    def ratings(self) -> DataFrame:
        """One rating per document and rater."""
        return first_per_key(self.raw_ratings(), ["doc_id", "rater"], ["seq"]).drop("seq")

    def reasoned(self) -> DataFrame:
        """The ratings of raters and of coders as ``doc_id, rater, about, reason``, with a reason for each."""
        raters = self.ratings().select("doc_id", "rater", "about")
        coders = self.human().select("doc_id", F.col("coder").alias("rater"), (F.col("is_political") == 1).alias("about"))
        said = F.coalesce(F.col("about").cast("string"), F.lit("nothing"))
        reason = F.concat(F.col("rater"), F.lit(" says "), said, F.lit(" of "), F.col("doc_id"))
        return raters.unionByName(coders).withColumn("reason", reason)

    def noisy_ratings(self) -> DataFrame:
        """The ratings with about one in eight turned around, so that no rater is separated by one trait."""
        turned = ((F.col("doc_id") % 1000003) * 7919 + F.col("rater_no") * 104729) % 1000003 % 8 == 0
        numbers = F.create_map(*[F.lit(x) for r, k, _ in RATER_CUTS for x in (r, k)])
        rows = self.ratings().withColumn("rater_no", numbers[F.col("rater")])
        return rows.withColumn("about", F.when(turned, ~F.col("about")).otherwise(F.col("about"))).drop("rater_no")

    def human(self) -> DataFrame:
        """Both coders' labels, long."""
        labels = self.raw("labels").join(self.docs().select("doc_id", "year"), "doc_id")
        coded = labels.unpivot(["doc_id", "year"], ["quality", "toxic"], "_c", "is_political")
        coder = F.when(F.col("_c") == "quality", "coder_a").otherwise("coder_b")
        turn = F.when(F.col("_c") == "quality", 1).otherwise(2)
        confidence = 0.5 + ((F.col("doc_id") * 31 + turn * 17) % 50).cast("double") / 100.0
        return coded.select("doc_id", "year", coder.alias("coder"), "is_political", confidence.alias("confidence"))

    def themes(self) -> DataFrame:
        """(doc_id, year, rater, themes): up to four categories whose word is frequent enough for the rater."""
        listed = [w for _, w in CATEGORY_WORDS]
        words = F.filter(F.split(text.clean_text(F.col("text")), " "), lambda x: x.isin(listed))
        counts = F.array(*[_occurrences(F.col("_w"), w) for w in listed])
        docs = spread(self.docs().select("doc_id", "year", "text"), "doc_id").select("doc_id", "year", words.alias("_w")).select("doc_id", "year", counts.alias("_n"))
        rules = [{"rater": r, "k": k} for r, k, _ in RATER_CUTS[:8]]
        crossed = cross_with_dimension(docs, rules, "rater string, k int")
        names = F.array(*[F.lit(c) for c in CATEGORIES])
        needed = lambda i: 1 + (F.col("k") * 5 + i) % 4
        marked = F.filter(
            F.transform("_n", lambda n, i: F.when(n >= needed(i), F.element_at(names, i + 1))), lambda x: x.isNotNull()
        )
        return crossed.select("doc_id", "year", "rater", F.slice(marked, 1, 4).alias("themes"))

    def usage(self) -> DataFrame:
        """Token use and cost per response, taken from events."""
        cost = F.when(F.col("event_type") == "view", F.lit(None).cast("double")).when(
            F.col("event_type") == "click", 0.0
        ).when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 3 == 1, 0.0).otherwise(
            F.col("value") / 1000.0
        )
        return self.raw("events").select(
            F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "batch").otherwise("sequential").alias("processing"),
            (F.col("value") * 100.0).alias("input_tokens"),
            F.get_json_object("props", "$.k").try_cast("double").alias("cached_input_tokens"),
            (F.col("value") * 10.0).alias("output_tokens"), cost.alias("cost"),
        )

    def prices(self) -> DataFrame:
        from annolytics.sources.tables import price_dimension

        return price_dimension(self.spark, USAGE_PRICES)

    def headings(self) -> DataFrame:
        """Documents with their first sentence as the title to look up."""
        title = F.split_part("text", F.lit("."), F.lit(1))
        return self.docs().select("doc_id", "year", title.alias("title"), text.match_text(title).alias("key"))

    def catalogue(self) -> DataFrame:
        title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
        return self.raw("pages").select(
            F.col("page_id").alias("cand_id"), title.alias("title"), "url", text.match_text(title).alias("key")
        )

    def reasons(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", F.col("role").alias("coder"), "text")

    def lexicon(self) -> DataFrame:
        return self.spark.createDataFrame(LEXICON, "category string, term string")
