"""SpotSigs fingerprints: chains of content words after common-word anchors, compared through pruned Jaccard.

Each common word of a text is an anchor; its signature is the anchor with the next ``CHAIN`` content words, of which
each ``STEP``-th is taken. The text's start counts as an anchor, so a text with words always has a signature, and a
chain may end early at the text's end. Where more than ``SPARSE`` content words follow each other without a common word,
as in tables or in a language without anchors, the word with the smallest hash of each ``CHAIN`` + 1 neighbours is an
anchor too (at ``STEP`` 1 every word there is then in a signature). A fingerprint is the ascending set of the signatures' 32-bit hashes, written
as eight hexadecimal digits each; the likeness of two is the Jaccard coefficient of these sets.

Defined cases: a null text is empty; a text without words has the empty fingerprint, whose likeness is 1 to another
empty one and 0 to any other; equal texts have equal fingerprints; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from annolytics.llm.common import text_or_empty
from annolytics.llm.neighbours import with_next

WORD = re.compile(r"[^\W_]+")
STEP, CHAIN = 1, 3
#: Longest stretch of content words that needs no anchors of its own.
SPARSE = 8
#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he in is it not of on or she that the they this to was were will "
    "with you au aux ce dans de des du elle en est et il la le les mais ou par pas plus pour que qui se sur un une "
    "auch auf aus das dem den der die ein eine er es für im ist mit nicht oder sich sie sind und von wir zu "
    "al como con del el ella ellos las lo los no o para pero por su sus una y".split()
)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words kept with their hash inside a task before the table starts anew.
KNOWN_WORDS = 500_000


class Signatures:
    """Signature sets of texts; remembers the hashes of words it has met."""

    def __init__(self, step: int = STEP, chain: int = CHAIN):
        self.step, self.chain = step, chain
        self.known: dict[str, int] = {}
        self.anchors = np.sort(np.array([xxh64_intdigest(w) for w in ANCHORS], np.uint64))

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        return np.array([known.get(w) or known.setdefault(w, xxh64_intdigest(w)) for w in words], np.uint64)

    def sparse_anchors(self, content: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Places of the content words that are anchors, given the places in front of which a common word stands."""
        width = self.chain + 1
        edges = np.concatenate(([0], cuts, [len(content)]))
        stretch = np.repeat(np.diff(edges), np.diff(edges))  # length of the stretch that a content word is in
        if len(content) < width or not (stretch > SPARSE).any():
            return np.empty(0, np.int64)
        part = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        starts = np.flatnonzero((stretch[: 1 - width] > SPARSE) & (part[: 1 - width] == part[width - 1 :]))
        ranks = (content ^ (content >> np.uint64(31))) * ODD
        return np.unique(starts + np.lib.stride_tricks.sliding_window_view(ranks, width)[starts].argmin(axis=1))

    def of(self, text: str) -> np.ndarray:
        """Ascending distinct 32-bit hashes of the signatures."""
        words = WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.uint32)
        h = self.hashes(words)
        common = self.anchors[np.minimum(np.searchsorted(self.anchors, h), len(self.anchors) - 1)] == h
        content = np.append(h[~common], np.zeros(self.step * self.chain, np.uint64))
        before = np.cumsum(~common)  # content words up to each place: where the chain of an anchor begins
        begins = np.concatenate(([0], before[common]))
        mixed = np.concatenate((np.array([7], np.uint64), h[common]))
        own = self.sparse_anchors(h[~common], before[common])
        if len(own):
            begins, mixed = np.concatenate((begins, own + 1)), np.concatenate((mixed, h[~common][own]))
        for link in range(self.chain):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD + content[np.minimum(begins + link * self.step, len(content) - 1)]
        return np.unique(((mixed ^ (mixed >> np.uint64(32))) * ODD >> np.uint64(32)).astype(np.uint32))


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard coefficient of two ascending sets; 0 where it cannot reach ``at_least``.

    The sizes alone bound it by smaller / larger, which is the pruning between length partitions.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (len(a) + len(b) - both)
    return found if found >= at_least else 0.0


def length_partition(size: int, threshold: float) -> int:
    """Number of the length partition: sets that reach ``threshold`` lie in the same partition or in adjacent ones."""
    return int(np.floor(np.log(size) / -np.log(threshold))) if size else -1


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first code points of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_neighbours(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, step: int = STEP, chain: int = CHAIN
) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, with their likeness and that to the next document.

    The next document is the one before in id order; the last takes the first. Repeated ids stand in order of their
    texts. A document without id has no place in the order: its next document is none, and counts as empty.
    """
    out = df.select(
        F.col(id_column), F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("edited_sha256"),
        F.lit("").alias("fingerprint"), F.lit("").alias("edited_fingerprint"), F.lit(0.0).alias("near_edited"),
        F.lit(0.0).alias("near_next"), F.lit(0).cast("long").alias("n_signatures"),
    ).schema

    def work(pairs: Iterator[tuple[dict, dict | None]]) -> Iterator[dict]:
        signatures = Signatures(step, chain)
        ready: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint32))
        for row, following in pairs:
            text, other = row["_text"], following["_text"] if following else ""
            own = ready[1] if ready[0] == text else signatures.of(text)
            ready = (other, signatures.of(other))
            edited = edited_text(text, other)
            theirs = signatures.of(edited)
            yield {
                id_column: row[id_column], "n_chars": len(text),
                "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": written(own),
                "edited_fingerprint": written(theirs), "near_edited": jaccard(own, theirs),
                "near_next": jaccard(own, ready[1]), "n_signatures": len(own),
            }

    wanted = df.select(F.col(id_column), text_or_empty(text_column).alias("_text"))
    return with_next(wanted, id_column, "_text", work, out)


def near_pairs(df: DataFrame, fingerprint_column: str = "fingerprint", threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct fingerprints (``a`` < ``b``) whose likeness is at least ``threshold``.

    Equal fingerprints count once, so copies add nothing. Signatures are ordered by their hash; two sets that reach
    the threshold share one of their first size - ceil(threshold * size) + 1 signatures and lie in the same or
    adjacent length partitions, so only those meet.
    """

    @F.udf("struct<part:int, first:array<long>>")
    def prefix(text):
        values = np.frombuffer(bytes.fromhex(text), ">u4")
        need = len(values) - int(np.ceil(threshold * len(values) - 1e-9)) + 1
        return length_partition(len(values), threshold), values[:need].tolist()

    @F.udf("double")
    def likeness(a, b):
        return jaccard(np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4"), threshold)

    sets = df.select(F.col(fingerprint_column).alias("a")).where(F.length("a") > 0).distinct().withColumn("p", prefix("a"))
    keys = sets.select("a", F.col("p.part").alias("part"), F.explode("p.first").alias("signature"))
    probes = keys.select(
        F.col("a").alias("b"), "signature", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part")
    )
    met = keys.join(probes, ["part", "signature"]).where("a < b").select("a", "b").distinct()
    return met.withColumn("likeness", likeness("a", "b")).where(F.col("likeness") >= threshold)
