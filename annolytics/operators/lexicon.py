"""Lexicon scores per document and seed expansion over an embedding table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import stats, text
from annolytics.operators.relational import salted_lookup
from annolytics.operators.windows import top_per_group
from annolytics.session import BROADCAST_BYTES, BROADCAST_ROWS, by_document, materialize, spread

SEEDS_AT_ONCE = 4096  # seeds that a task multiplies with vectors at a time
VECTORS_AT_ONCE = 1024


def token_totals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.size(text.tokens(text.clean_text(F.col(text_col)))).alias("tokens"))


def grams(docs: DataFrame, id_col: str, text_col: str, longest: int = 1) -> DataFrame:
    """(id, tokens, term, n): counted runs of one to ``longest`` words, with the document's word count.

    Documents are hashed by their id before their runs are made, so the runs themselves are not shuffled.
    """
    return _runs(by_document(docs.select(id_col, text_col), id_col), id_col, text_col, longest).groupBy(id_col, "tokens", "term").agg(F.count(F.lit(1)).alias("n"))


def _runs(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(id, tokens, term), one row per run of words."""
    words = spread(docs.select(id_col, text_col), id_col).select(
        id_col, text.tokens(text.clean_text(F.col(text_col))).alias("_words")
    )
    runs = [text.ngrams(F.col("_words"), n) for n in range(1, longest + 1)]
    terms = runs[0] if longest == 1 else F.concat(*runs)
    return words.select(id_col, F.size("_words").alias("tokens"), F.explode(terms).alias("term"))


def build_trie(terms: Sequence[str]) -> dict:
    """Words of the terms as nested dicts; the empty key of a node holds the term that ends there."""
    root: dict = {}
    for term in terms:
        node = root
        for word in term.split(" "):
            node = node.setdefault(word, {})
        node[""] = term
    return root


def trie_hits(words: Sequence[str], root: dict) -> dict[str, int]:
    """Counts of the terms that stand in a text, found in one walk over its words."""
    found: dict[str, int] = {}
    for start, word in enumerate(words):
        node, at = root.get(word), start + 1
        while node is not None:
            if (term := node.get("")) is not None:
                found[term] = found.get(term, 0) + 1
            node = node.get(words[at]) if at < len(words) else None
            at += 1
    return found


def phrase_hits(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, longest: int) -> DataFrame:
    """(id, tokens, term, n): the terms (column ``term``) of up to ``longest`` words that a document holds.

    Terms within the broadcast bound become a trie that tasks walk in the order of the words, so nothing but hits leaves
    a task. A longer list is joined with the counted runs of words.
    """
    wanted = terms.where(F.col("term").isNotNull()).select("term").distinct()
    rows, size = wanted.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if rows > BROADCAST_ROWS or size > BROADCAST_BYTES:
        return attach_by_term(grams(docs, id_col, text_col, longest), wanted, "term").select(id_col, "tokens", "term", "n")
    root = build_trie([t for (t,) in wanted.collect() if 0 < len(t.split(" ")) <= longest and "" not in t.split(" ")])
    words = text.tokens(text.clean_text(F.col(text_col)))
    split = spread(docs.select(id_col, text_col), id_col).select(F.col(id_col).alias("id"), words.alias("words"))
    id_type = split.schema["id"].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            places, tokens, found, counts = [], [], [], []
            for place, words in enumerate(batch.column("words").to_pylist()):
                for term, n in trie_hits(words or (), root).items():
                    places.append(place)
                    tokens.append(len(words))
                    found.append(term)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(places, pa.int32())), pa.array(tokens, pa.int32()), pa.array(found, pa.string()), pa.array(counts, pa.int64())],
                names=["id", "tokens", "term", "n"],
            )

    hits = split.mapInArrow(walk, f"id {id_type.simpleString()}, tokens int, term string, n long")
    return hits.select(F.col("id").alias(id_col), "tokens", "term", "n")


def category_scores(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, longest: int = 1) -> DataFrame:
    """(id, category, hits, score): hits over words, for categories with a hit.

    Words that are no lexicon term drop out before the shuffle when the lexicon fits the broadcast bound; a larger
    lexicon is joined by key, which copes with frequent words through adaptive skew handling.
    """
    pairs = lexicon.where(F.col("term").isNotNull()).select("category", "term").distinct()
    width = F.octet_length("term") + F.octet_length(F.coalesce("category", F.lit("")))
    rows, size = pairs.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        hits = _runs(docs, id_col, text_col, longest).join(F.broadcast(pairs), "term").withColumn("n", F.lit(1))
    else:
        hits = grams(docs, id_col, text_col, longest).join(pairs, "term")
    return hits.groupBy(id_col, "category").agg(
        F.sum("n").alias("hits"), stats.ratio(F.sum("n"), F.max("tokens")).alias("score")
    )


def scores_wide(docs: DataFrame, id_col: str, scores: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per document with a score column per category; absent scores are 0."""
    cells = [F.max(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in categories]
    found = scores.groupBy(id_col).agg(*cells)
    return docs.join(found, id_col, "left").fillna(0.0, list(categories))


def any_signal(scored: DataFrame, measures: Sequence[str]) -> DataFrame:
    return scored.where(F.greatest(*[F.coalesce(F.col(m), F.lit(0.0)) for m in measures]) > 0)


def topics_of(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.col("category").alias("topic")).distinct()


def unreachable_seeds(lexicon: DataFrame, longest: int) -> DataFrame:
    """Terms the tokeniser can never produce: too many words, or characters cleaning takes away."""
    same = text.join_key(F.col("term")) == F.col("term")
    words = F.size(text.tokens(text.clean_text(F.col("term"))))
    return lexicon.where(~same | (words > longest) | (words == 0)).select("category", "term")


class _Best:
    """The ``k`` nearest vectors of each seed so far; equal ones by id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        self.held = [(np.empty(0, dtype=object), np.empty(0))] * len(ids)

    def add(self, own: np.ndarray, vectors: np.ndarray) -> None:
        x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        cosine = np.round(x @ self.matrix.T, 9)
        for s in range(len(self.ids)):
            keep = np.flatnonzero(own != self.ids[s])
            if len(keep) > self.k:  # every row tied with the k-th best stays for the id tie-break
                least = np.partition(cosine[keep, s], -self.k)[-self.k]
                keep = keep[cosine[keep, s] >= least]
            both, score = np.append(self.held[s][0], own[keep]), np.append(self.held[s][1], cosine[keep, s])
            best = np.lexsort((both, -score))[: self.k]
            self.held[s] = both[best], score[best]


def nearest_to_seeds(
    vectors: DataFrame, id_col: str, vector_col: str, seeds: DataFrame, seed_key: str, k: int, at_once: int = SEEDS_AT_ONCE
) -> DataFrame:
    """The ``k`` rows with the highest cosine to each seed, seeds themselves left out.

    Seeds that a task can hold go to the tasks, which multiply their batches of vectors with them and pass on their own
    top ``k`` of each seed, so neither the pairs nor the vectors are shuffled. More seeds are dealt to blocks of that size
    and vectors to parts; a vector then moves once for each block of seeds, and each block meets each part in a task.
    """
    chosen = materialize(seeds.select(F.col(seed_key).alias("_key"), F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), "seeds")
    count = chosen.count()
    key_type, id_type = seeds.schema[seed_key].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    schema = f"{seed_key} {key_type}, seed_id {id_type}, {id_col} {id_type}, cosine double"

    def frames(keys: Sequence, best: _Best) -> pd.DataFrame:
        n = [len(own) for own, _ in best.held]
        return pd.DataFrame({
            seed_key: np.repeat(np.array(keys, dtype=object), n), "seed_id": np.repeat(best.ids, n),
            id_col: [i for own, _ in best.held for i in own], "cosine": np.concatenate([np.empty(0), *[c for _, c in best.held]]),
        })

    def stacked(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(np.float64)

    if count <= at_once:
        rows = sorted(chosen.collect(), key=lambda r: (str(r["_key"]), r["_id"]))
        keys, ids, matrix = [r["_key"] for r in rows], np.array([r["_id"] for r in rows]), np.array([r["_v"] for r in rows], dtype=np.float64)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(ids, matrix, k) if len(ids) else None
            for batch in batches:
                for i in range(0, len(batch) if best else 0, VECTORS_AT_ONCE):
                    part = batch.iloc[i : i + VECTORS_AT_ONCE]
                    best.add(part[id_col].to_numpy(), stacked(part[vector_col]))
            if best:
                yield frames(keys, best)

        near = vectors.select(id_col, vector_col).mapInPandas(partial, schema)
    else:
        blocks = -(-count // (at_once // 2 or 1))  # by hash, so half full on average
        parts = max(1, -(-vectors.count() // (at_once * 4)))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = vectors.select(F.col(id_col).alias("_own"), F.col(vector_col).alias("_x"), deal(id_col, parts).alias("_part"), every(blocks).alias("_block"))
        right = chosen.select("*", deal("_id", blocks).alias("_block"), every(parts).alias("_part"))

        def meet(x: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
            if x.empty or seed.empty:
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            found = []
            for s in range(0, len(seed), at_once):
                some = seed.iloc[s : s + at_once]
                best = _Best(some["_id"].to_numpy(), stacked(some["_v"]), k)
                for i in range(0, len(x), VECTORS_AT_ONCE):
                    part = x.iloc[i : i + VECTORS_AT_ONCE]
                    best.add(part["_own"].to_numpy(), stacked(part["_x"]))
                found.append(frames(some["_key"].tolist(), best))
            return pd.concat(found)

        near = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInPandas(meet, schema)
    return top_per_group(near, [seed_key, "seed_id"], [F.desc("cosine"), F.asc(id_col)], k)


def known_item_scores(known: DataFrame, scored: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Scores of a curated list; items that were not scored get 0, scores are rounded to three places."""
    joined = known.join(scored.select(*keys, *measures), list(keys), "left")
    return joined.select(
        *known.columns, *[F.round(F.coalesce(F.col(m), F.lit(0.0)), 3).alias(m) for m in measures]
    )


def attach_by_term(rows: DataFrame, dim: DataFrame, term: str, counts: DataFrame | None = None) -> DataFrame:
    """Attach one row per term to (doc, term) rows, where a few terms may fill a large part of them.

    ``counts`` is the number of rows ``_n`` of every term, where it is known.
    """
    if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(dim), term)
    return salted_lookup(rows, dim, term, counts, how="inner")
