"""Exact Jaccard join on word n-grams by token-combination prefixes, as connected components.

The distinct n-grams of a text are its tokens, named by 64-bit hashes; equal sets are one class. Two classes link when
100 * intersection >= percent * union. A text of n tokens that links with another one shares all but at most
``misses(n)`` = floor(n * (100 - percent) / 100) of its tokens with it. The work:

1. One pass writes size and class of every text with its tokens in a fixed part of the hash space (all tokens of a
   short text). There the number of texts per token is exact. A class with more than ``misses(n)`` tokens that no
   other class has is linked with nothing, and is done; in prose that is nearly every text without near copies.
2. The texts of the other classes are fetched. Their tokens are ordered by class of frequency, then hash: rare tokens
   first, frequent ones (in one of ``FREQUENT_SHARE`` texts or more) last. The prefix takes rare tokens one by one; a
   frequent token joins one of ``GROUPS`` groups, of which pairs are the keys. A group holding g prefix tokens must lose
   g - 1 of them before no pair is left, so the prefix is extended until its tokens, less one for each group begun,
   exceed ``misses(n)``. Whichever of two linked texts has the shorter prefix shares a key with the other.
   Prefixes of rare tokens are ``SURE`` - 1 tokens longer than that, so two of them share as many keys as ``SURE``.
3. The hub of a key is the least of its classes by hash, and the home of a class the hub of most of its keys. The classes
   of a home and of like size are cut in blocks of about ``BLOCK``; blocks of one home meet. A class meets a
   larger block of another home only if they share as many keys as linked texts must, so texts with a few tokens in common
   by chance do not meet, however long the chains they form. Each pair of blocks is one group that intersects its sets by matrix
   products, and returns for each class its number of links and the class it is linked to. No pair becomes a row.
4. Components over these links; the smallest id names each.

Defined cases: null and wordless texts have an empty set, link with nothing and are their own component; a text with
fewer words than n has its whole sequence as its one token; rows without id take part, and are the smallest of a
component only where it has no id at all (then null); repeated rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from annolytics.llm.common import column_of, slices, spread_out, text_or_empty, texts_of
from annolytics.llm.components import components
from annolytics.session import discard, materialize

#: A token is frequent from this share of all texts on, and from this many; so at most (tokens in the counted part of
#: the hash space per text) / share are frequent at any size of the corpus: those are sent to the executors.
FREQUENT_SHARE, FREQUENT_LEAST = 1 / 1000, 64
GROUPS = np.uint64(8)
BLOCK = 256
SURE = 8
#: The counted part of the hash space is the share of tokens that may miss and this much more, which leaves room for
#: the chance in hashing; sets up to a size are counted whole.
COUNTED_MORE, SHORT = 0.1, 64
#: Sets apart the class ids of texts whose tokens count for others only.
MARK = 0x5DEECE66D1234567
ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
KNOWN_WORDS = 500_000


def misses(n: int, percent: int) -> int:
    return n * (100 - percent) // 100


def scarce_set(percent: int) -> int:
    """Size up to which the groups could use a set's tokens up, so that it may have no pairs enough."""
    return max(n for n in range(1, 100) if n - int(GROUPS) < misses(n, percent) + 1)


def small_set(percent: int) -> int:
    """Size up to which sets are indexed by all their tokens."""
    return scarce_set(percent) * 100 // percent


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD2
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Token sets of texts; remembers the hashes of words it has met."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: str) -> np.ndarray:
        """Ascending distinct hashes of the n-grams; words are split at ASCII white space and lower-cased in ASCII."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        h = np.array([known.get(w) or known.setdefault(w, xxh64_intdigest(w)) for w in words], np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * ODD + h[i : len(h) - k + 1 + i]
        return np.unique(mixed(out))


def class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set: its rare prefix tokens, and pairs of frequent ones of the same group.

    A set so small that its groups could use its tokens up has all its tokens as keys. One that could link with such a
    set has them too, beside its prefix keys, by which it meets larger sets.
    """
    return sure_keys(tokens, frequent, percent)[0]


def sure_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys of one set, and a number: two linked sets share as many keys as the smaller of their numbers says."""
    need = misses(len(tokens), percent) + 1
    if len(tokens) <= scarce_set(percent):
        return tokens, min(SURE, len(tokens) - need + 1)
    single = tokens[: len(tokens) if len(tokens) <= small_set(percent) else 0]
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    else:
        often = np.zeros(len(tokens), bool)
    rare = tokens[~often][: need + SURE - 1]
    if len(rare) >= need:
        return single if len(single) else rare, len(rare) - need + 1
    rest = tokens[often]
    group = rest % GROUPS
    begun = np.zeros(len(rest), bool)
    begun[np.unique(group, return_index=True)[1]] = True
    weight = np.cumsum(~begun)
    enough = int(np.searchsorted(weight, need - len(rare))) + 1
    rest, group = rest[:enough], group[:enough]
    pairs = []
    for g in range(int(GROUPS)):
        own = rest[group == g]
        i, j = np.triu_indices(len(own), 1)
        pairs.append(mixed(own[i] * ODD + own[j]))
    return np.concatenate([single if len(single) else rare, *pairs]), 1


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of links between sets, by products of the incidence matrix in column strips."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    strip = np.cumsum(count > 1)[place[shared]] - 1
    owner = owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(strip, kind="stable")
    strip, owner = strip[order], owner[order]
    width = 4096
    for start in range(0, int(strip[-1]) + 1 if len(strip) else 0, width):
        lo, hi = np.searchsorted(strip, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], strip[lo:hi] - start] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    out = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def labels_of(links: np.ndarray) -> np.ndarray:
    """Smallest reachable place for each row of a symmetric link matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).withColumn(
        "th", F.xxhash64("text")
    )


def _short_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _rows(texts: DataFrame, words: int) -> DataFrame:
    """Size and class of every text: ``doc_id, n, class, cid, th``."""
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, n long, class binary, cid long, th long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches):
            sets = [shingles.of(t) for t in texts_of(batch, "text")]
            found = [class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.binary()),
                 pa.array(map(_short_id, found), pa.int64()), batch.column("th")],
                names=["doc_id", "n", "class", "cid", "th"],
            )

    return spread_out(texts).mapInArrow(run, schema)


def _counted(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(cid, token)`` for the tokens of every text in the counted part of the hash space.

    Texts of at most ``SHORT`` tokens are judged by all of them; so those that could link with them, a little longer,
    give their other tokens under a mark: these count for others, but not for themselves.
    """
    below = np.uint64(min((100 - percent) / 100 + COUNTED_MORE, 1.0) * (2**64 - 2048))
    longest = SHORT * 100 // percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches):
            ids, tokens = [], []
            for text in texts_of(batch, "text"):
                s = shingles.of(text)
                at = len(s) if len(s) <= SHORT else int(np.searchsorted(s, below))
                ids.append(_short_id(class_of(s)))
                tokens.append(s[:at].view(np.int64))
                if at < len(s) <= longest:
                    ids.append(ids[-1] ^ MARK)
                    tokens.append(s[at:].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(tokens)], names=["cid", "tokens"])

    return spread_out(texts.select("text")).mapInArrow(run, "cid long, tokens array<long>").select("cid", F.explode("tokens").alias("token"))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def _open_sets(texts: DataFrame, still: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """Sets and keys of the classes in ``still``, from the text of one document of each."""
    wanted = still.select(F.col("doc_id").alias("d"), F.col("th").alias("h"))
    kept = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left_semi")
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, often = Shingles(words), sent.value
        for batch in slices(batches):
            sets = [shingles.of(t) for t in column_of(batch, "text")]
            keys, sure = zip(*[sure_keys(s, often, percent) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.binary()), lists([k.view(np.int64) for k in keys]),
                 pa.array(sure, pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["class", "keys", "sure", "tokens"],
            )

    return kept.select("text").mapInArrow(run, "class binary, keys array<long>, sure int, tokens binary")


def band_of(size: Column, percent: int) -> Column:
    """Sizes of linked sets lie in the same band or in adjacent ones."""
    return F.floor(F.log(size) / -math.log(percent / 100) + 1e-9).cast("int")


PLACE = "struct<home:long,band:int,block:int>"
PAIRS = f"array<struct<a:{PLACE},b:{PLACE}>>"


def _homes(held: DataFrame) -> DataFrame:
    """``class, home, band, block`` and more of each class in ``held`` (class, band, sure, key, hub).

    ``blocks`` counts the blocks of its home and band, ``above`` and ``below`` those of the bands beside; ``weak`` is the
    least number of keys that some class of its home and band surely shares.
    """
    most = F.max_by("hub", F.struct("n", "hub")).alias("home")
    counted = held.groupBy("class", "band", "sure", "hub").agg(F.count(F.lit(1)).alias("n"))
    homes = materialize(counted.groupBy("class", "band", "sure").agg(most), "homes")
    sizes = homes.groupBy("home", "band").agg(
        F.count(F.lit(1)).alias("members"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("sure").alias("weak")
    )
    by_band = Window.partitionBy("home").orderBy("band")
    beside = lambda f, step: F.when(f("band").over(by_band) == F.col("band") + step, f("blocks").over(by_band)).otherwise(0)
    sizes = sizes.withColumns({"above": beside(F.lead, 1), "below": beside(F.lag, -1)})
    blocks = materialize(
        homes.join(sizes, ["home", "band"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "blocks"
    )
    discard(homes)
    return blocks


def _meetings(held: DataFrame) -> DataFrame:
    """``class, first, tile``: the pairs of blocks each class is in, and whether it stands in the first of the two.

    A block meets the blocks of its own home and band and of the two bands beside. Of two blocks of different homes, the
    classes of the smaller one that share keys enough with the larger one meet all of it, so a large group is not counted
    class by class. Only keys that some class has without being at home with their hub can be shared like that.
    """
    homes = _homes(held)
    counted = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda band, block: F.struct(F.col("home").alias("home"), band.alias("band"), block.alias("block"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    band, own = F.col("band"), place(F.col("band"), F.col("block")).alias("own")
    same = F.when(F.col("members") > 1, F.transform(counted("blocks"), lambda q: pair(own, place(band, q))))
    inside = homes.select("class", own, F.explode(F.concat(
        F.coalesce(same, F.array().cast(PAIRS)),
        F.transform(counted("above"), lambda q: pair(own, place(band + 1, q))),
        F.transform(counted("below"), lambda q: pair(own, place(band - 1, q))),
    )).alias("tile"))

    strange = held.join(homes.select("class", "home"), "class").where("hub != home").select("key").distinct()
    placed = held.select("class", "key").join(strange, "key", "left_semi").join(homes.select("class", "sure", "weak", "members", own), "class")
    placed = materialize(placed, "placed")
    larger = placed.groupBy("key").agg(F.collect_set(F.struct("members", "own", "weak")).alias("q")).where("size(q) > 1")
    other = lambda q: (
        (q["own"]["home"] != F.col("own.home")) & (F.abs(q["own"]["band"] - F.col("own.band")) <= 1)
        & (F.struct(q["members"], q["own"]) > F.struct("members", "own"))
    )
    met = placed.join(larger, "key").select("class", "own", "sure", F.explode(F.filter("q", other)).alias("q"))
    met = met.groupBy("class", "own", "sure", "q").agg(F.count(F.lit(1)).alias("n")).where("n >= least(sure, q.weak)")
    met = materialize(met.select("class", "own", F.col("q.own").alias("other"), pair(F.col("own"), F.col("q.own")).alias("tile")), "met")
    whole = homes.select("class", own).join(met.select(F.col("other").alias("own"), "tile").distinct(), "own")
    rows = inside.unionByName(met.drop("other")).unionByName(whole.select("class", "own", "tile"))
    rows = materialize(rows.select("class", (F.col("own") == F.col("tile.a")).alias("first"), "tile"), "meetings")
    discard(homes, placed, met)
    return rows


def _tiles(meetings: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the classes that meet: ``class, to, links`` for each class and pair of blocks it is in."""
    member = meetings.join(sets.select("class", "tokens").join(found.select("class", "copies"), "class"), "class")

    def run(key, table):
        rows = {r["class"]: r for r in table.to_pylist()}  # a class may come twice where whole rows are repeated
        nodes = list(rows)
        links = linked([np.frombuffer(rows[n]["tokens"], np.uint64) for n in nodes], percent)
        tile = key[0].as_py()
        if tile["a"] != tile["b"]:
            first = np.array([rows[n]["first"] for n in nodes])
            links &= first[:, None] != first[None, :]
        copies = np.array([rows[n]["copies"] for n in nodes], np.int64)
        return pa.table(
            {"class": pa.array(nodes, pa.binary()), "to": pa.array([nodes[i] for i in labels_of(links)], pa.binary()),
             "links": pa.array(links @ copies, pa.int64())}
        )

    return member.groupBy("tile").applyInArrow(run, "class binary, to binary, links long")


def classes(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = 3, percent: int = 90
) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, n, class)`` and classes ``(class, n, doc_id, th, copies, root, component_id, n_links)``."""
    texts = _texts(df, id_column, text_column)
    rows = materialize(_rows(texts, words), "rows")
    found = materialize(
        rows.groupBy("class").agg(
            F.max("n").alias("n"), F.max("cid").alias("cid"), F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"),
        ).select("class", "n", "cid", "copies", "first.doc_id", "first.th"), "classes",
    )
    least = max(FREQUENT_LEAST, int(rows.count() * FREQUENT_SHARE))
    counted = _counted(texts, words, percent).groupBy("token").agg(
        F.min("cid").alias("low"), F.max("cid").alias("high"), F.count(F.lit(1)).alias("texts")
    )
    alone = F.col("low") == F.col("high")
    kept = counted.where(alone | (F.col("texts") >= least)).select(
        alone.alias("alone"), F.when(alone, F.col("low")).otherwise(F.col("token")).alias("id")
    )
    tallied = materialize(kept.groupBy("alone", "id").agg(F.count(F.lit(1)).alias("own")), "tallies")
    often = np.sort(np.array([r.id for r in tallied.where("not alone").select("id").toLocalIterator()], np.int64).view(np.uint64))
    still = found.where("n > 0").join(tallied.where("alone").select(F.col("id").alias("cid"), "own"), "cid", "left").where(
        F.coalesce("own", F.lit(0)) <= F.floor(F.col("n") * (100 - percent) / 100)
    )
    sets = materialize(_open_sets(texts, still, often, words, percent), "open")
    keys = sets.select("class", band_of(F.length("tokens") / 8, percent).alias("band"), "sure", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min(F.xxhash64("class")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    held = materialize(keys.join(hubs, "key"), "held")
    meetings = _meetings(held)
    discard(tallied, held)
    tiles = materialize(_tiles(meetings, found, sets, percent), "tiles")
    discard(meetings, sets)
    joined = components(tiles.select(F.col("class").alias("a"), F.col("to").alias("b")))
    links = tiles.groupBy("class").agg(F.sum("links").alias("others"))
    named = materialize(
        found.join(joined.select(F.col("node").alias("class"), "root"), "class", "left").join(links, "class", "left").select(
            "class", "n", "doc_id", "th", "copies", F.coalesce("root", "class").alias("root"),
            F.when(F.col("n") > 0, F.coalesce("others", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"),
        ), "named",
    )
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "n", "class"), named.join(smallest, "root")


def join(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = 3, percent: int = 90
) -> DataFrame:
    """For each row its number of n-grams, its component and the number of other rows it links with directly."""
    rows, named = classes(df, id_column, text_column, words=words, percent=percent)
    named = materialize(named.select("class", "component_id", "n_links"), "answers")
    return rows.join(named, "class", "left").select(
        F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "n_links",
    )


def one_of_each(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the smallest id; wordless rows stay."""
    _, named = classes(df, id_column, text_column, words=words, percent=percent)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class", "th")
    first = named.where("n > 0").groupBy("root").agg(F.min(rank).alias("r")).select(F.struct("r.doc_id").alias("_id"), F.col("r.th").alias("_th"))
    # the caller's columns travel as one, so that none of them can clash; ids in a struct are equal where both are null, and
    # the copies of a row are where the join left it
    text = text_or_empty(text_column)
    marked = df.select(F.struct(*df.columns).alias("_row"), F.struct(F.col(id_column).alias("doc_id")).alias("_id"), F.xxhash64(text).alias("_th"), text.rlike(r"[^\x20\x09-\x0D]").alias("_worded"))
    kept = marked.where("_worded").join(first.hint("shuffle_hash"), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])
    return kept.unionByName(marked.where("not _worded")).select("_row.*")
