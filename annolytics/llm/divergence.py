"""Source divergence audit: how the word use of each source departs from its language and from the other sources.

In-mapper stripes: a task folds whole documents into hash tables, the documents of a language that hold a term and the
occurrences in each of its sources. What a task holds goes out as stripes, one row ``(lang, term, docs, sources,
counts)`` for each term, at the end and whenever the tables pass ``HELD`` entries. Stripes are shuffled by language and
term, sorted, and merged as they stream by, so a term is one stripe per spill and never one row per document. A merged
stripe that reaches ``least_docs`` documents is kept. With the totals of the sources at hand a kept stripe directly gives
its divergences: the excess of every source over the language, and the differences of all pairs of sources, which are
summed inside the task.

With V kept terms in a language, N occurrences of them in a group and ``count`` of one term, the term weighs
``p = 1 + floor(10^9 (count + 5) / (N + 5 V))`` there. All arithmetic is in whole numbers.

Defined cases: null texts, languages and sources are empty strings; a source without any kept term has N = 0; a language
without kept terms has pairs of value 0 and no terms; repeated rows are separate documents; an empty table gives no rows;
extra columns are not read. The result holds a row for each ordered pair of sources of a language, by definition.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.common import spread_out, text_or_empty
from annolytics.session import materialize

#: Entries (term and source) that a task holds before it spills its stripes.
HELD = 1_500_000
#: Kept terms that one part of a language takes in at a time when divergences are summed.
PART_TERMS = 4096
SCALE, PRIOR = 10**9, 5

STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"

# A byte outside letters and outside UTF-8 sequences parts terms; A to Z become a to z.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, with A to Z lower-cased, as UTF-8."""
    return text.translate(FOLDED).split()


class Stripes:
    """The tables of one task: documents by language and term, occurrences by language, source and term."""

    def __init__(self) -> None:
        self.docs: dict[bytes, Counter] = defaultdict(Counter)
        self.counts: dict[bytes, dict[bytes, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.held = 0

    def fold(self, lang: bytes, source: bytes, text: bytes) -> None:
        """Take in one document. The empty term counts the documents themselves, so a group without terms is seen."""
        terms = terms_of(text)
        docs, counts = self.docs[lang], self.counts[lang][source]
        before = len(docs) + len(counts)
        docs.update(set(terms))
        docs[b""] += 1
        counts.update(terms)
        counts[b""] += 1
        self.held += len(docs) + len(counts) - before

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes, a language at a time; the tables are empty afterwards."""
        for lang, docs in self.docs.items():
            tables = self.counts[lang]
            terms = pa.array(list(docs), pa.binary())
            of_entry = pa.array(list(chain.from_iterable(tables.values())), pa.binary())
            places = pc.index_in(of_entry, value_set=terms).to_numpy()
            counts = np.fromiter(chain.from_iterable(t.values() for t in tables.values()), np.int64, len(places))
            sources = np.repeat(np.arange(len(tables), dtype=np.int32), [len(t) for t in tables.values()])
            order = np.argsort(places, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(terms)))])
            names = pa.array([*tables], pa.binary()).cast(pa.string())
            yield from _stripes(
                pa.repeat(pa.scalar(lang, pa.binary()), len(terms)), terms, np.fromiter(docs.values(), np.int64, len(docs)), ends,
                pa.DictionaryArray.from_arrays(sources[order], names), counts[order],
            )
        self.__init__()


def _stripes(langs: pa.Array, terms: pa.Array, docs: np.ndarray, ends: np.ndarray, sources: pa.DictionaryArray, counts: np.ndarray, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Stripes as record batches; stripe i holds the entries from ``ends[i]`` to ``ends[i + 1]``."""
    for at in range(0, len(terms), rows):
        part = ends[at : at + rows + 1]
        offsets = pa.array((part - part[0]).astype(np.int32))
        names = sources.slice(part[0], part[-1] - part[0]).cast(pa.string())
        numbers = pa.array(counts[part[0] : part[-1]])
        yield pa.RecordBatch.from_arrays(
            [
                langs.slice(at, rows).cast(pa.string()), terms.slice(at, rows).cast(pa.string()), pa.array(docs[at : at + rows]),
                pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, numbers),
            ],
            names=["lang", "term", "docs", "sources", "counts"],
        )


def _bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def fold_documents(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Documents ``lang, source, text`` to the stripes of one task."""
    tables = Stripes()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = batch.slice(start, 256)
            for lang, source, text in zip(*(_bytes_of(rows, c) for c in ("lang", "source", "text"))):
                tables.fold(lang, source, text)
                if tables.held > held:
                    yield from tables.spill()
    yield from tables.spill()


def _merged(rows: pa.RecordBatch, least_docs: int) -> list[pa.RecordBatch]:
    """Stripes in order to one stripe per key; short ones go, but for the last, whose key may go on."""
    lang, term = rows.column("lang"), rows.column("term")
    n = rows.num_rows
    new = pc.or_(pc.not_equal(term.slice(1), term.slice(0, n - 1)), pc.not_equal(lang.slice(1), lang.slice(0, n - 1)))
    first = np.concatenate([[True], new.to_numpy(zero_copy_only=False)])
    docs = np.add.reduceat(rows.column("docs").to_numpy(), np.flatnonzero(first))
    kept = (docs >= least_docs) | (pc.binary_length(term).to_numpy(zero_copy_only=False)[first] == 0)
    kept[-1] = True
    rows = rows.filter(pa.array(kept[np.cumsum(first) - 1]))
    first = first[kept[np.cumsum(first) - 1]]
    lists = rows.column("sources")
    sources = lists.flatten().dictionary_encode()
    stripe = np.repeat(np.cumsum(first) - 1, pc.list_value_length(lists).to_numpy())
    keys = stripe * len(sources.dictionary) + sources.indices.to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat(rows.column("counts").flatten().to_numpy()[order], starts)
    stripe, source = np.divmod(keys[starts], len(sources.dictionary))
    ends = np.concatenate([[0], np.cumsum(np.bincount(stripe, minlength=first.sum()))])
    heads = rows.filter(pa.array(first))
    merged = pa.DictionaryArray.from_arrays(source.astype(np.int32), sources.dictionary)
    return list(_stripes(heads.column("lang"), heads.column("term"), docs[kept], ends, merged, counts))


def merge_stripes(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Stripes in order of language and term to one stripe per key; those below ``least_docs`` go, the empty term stays.

    Each batch is merged with the one open stripe of those before it, so a key held by every task takes no more room.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch.cast(last.schema)]).combine_chunks().to_batches()[0]
        *done, end = _merged(rows, least_docs)
        yield from done
        if end.num_rows > 1:
            yield end.slice(0, end.num_rows - 1)
        last = end.slice(end.num_rows - 1)
    if last is not None and (last.column("docs")[0].as_py() >= least_docs or not last.column("term")[0].as_py()):
        yield last


def weigh(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total) by long division in base 1000: exact while ``total`` is below 9 * 10^15."""
    left, share = counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):
        left = left * 1000
        share = share * 1000 + left // total
        left = left % total
    return share + 1


class Emitter:
    """Divergences of the kept stripes of one part of a language."""

    #: Entries of a block of weights, and of the sums that are held between blocks.
    ENTRIES = 1 << 21

    def __init__(self, lang: str, top: int) -> None:
        self.lang, self.top = lang, top
        self.names: list[str] = []
        self.totals: list[int] = []
        self.terms = 0
        self.block: list[tuple[str, list, list]] = []
        self.best: list[list] = []
        self.sums: np.ndarray | None = None

    def group(self, source: str, total: int, terms: int) -> None:
        """Sources come before stripes. ``total`` is N of the group and ``terms`` is V."""
        self.names.append(source)
        self.totals.append(total)
        self.terms = terms

    def stripe(self, term: str, sources: list, counts: list) -> Iterator[pa.RecordBatch]:
        self.block.append((term, sources, counts))
        if len(self.block) * len(self.names) >= self.ENTRIES:
            yield from self.finish_block()

    def finish_block(self) -> Iterator[pa.RecordBatch]:
        if not self.block:
            return
        if self.sums is None:
            self.place = {name: i for i, name in enumerate(self.names)}
            self.best = [[] for _ in self.names]
            self.sums = np.zeros((len(self.names), len(self.names)), np.int64)
        counts = np.zeros((len(self.block), len(self.names)), np.int64)
        for row, (_, sources, numbers) in zip(counts, self.block):
            row[[self.place[s] for s in sources]] = numbers
        totals = np.array(self.totals, np.int64)
        p = weigh(counts, totals + PRIOR * self.terms)
        whole = weigh(counts.sum(1), totals.sum() + PRIOR * self.terms)
        for i in range(len(self.names)):
            self.sums[i] += np.abs(p - p[:, i : i + 1]).sum(0)
        excess = np.where(counts > 0, p - whole[:, None], 0)
        for i, found in enumerate(self.best):
            at = np.flatnonzero(excess[:, i] > 0)
            found += [(-int(excess[j, i]), self.block[j][0].encode()) for j in at]
            found[:] = heapq.nsmallest(self.top, found)
        self.block = []
        if self.sums.size > self.ENTRIES:
            yield from self.pairs()

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """The summed differences so far, a source at a time; sums of zero are given once, by the first part."""
        if self.sums is None:
            return
        for i, source in enumerate(self.names):
            at = np.flatnonzero(self.sums[i])
            if len(at):
                yield self._rows(source, "pair", [self.names[j] for j in at], self.sums[i][at])
        self.sums[:] = 0

    def finish(self, first: bool) -> Iterator[pa.RecordBatch]:
        yield from self.finish_block()
        yield from self.pairs()
        for source, found in zip(self.names, self.best):
            if found:
                yield self._rows(source, "term", [term.decode() for _, term in found], [-value for value, _ in found])
        if first:
            for source in self.names:
                others = [name for name in self.names if name != source]
                if others:
                    yield self._rows(source, "pair", others, [0] * len(others))

    def _rows(self, source: str, part: str, items: list, values) -> pa.RecordBatch:
        n = len(items)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n), pa.array([source] * n), pa.array([part] * n), pa.array(items, pa.string()), pa.array(values, pa.int64())],
            names=["lang", "source", "part", "item", "value"],
        )


def emit_divergences(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of language, part and term; the rows of sources have no term and stand first."""
    key, emitter = None, None
    for batch in batches:
        for row in (row for start in range(0, batch.num_rows, 4096) for row in batch.slice(start, 4096).to_pylist()):
            if (row["lang"], row["piece"]) != key:
                if emitter:
                    yield from emitter.finish(key[1] == 0)
                key, emitter = (row["lang"], row["piece"]), Emitter(row["lang"], top)
            if row["term"] is None:
                emitter.group(row["sources"][0], row["counts"][0], row["docs"])
            else:
                yield from emitter.stripe(row["term"], row["sources"], row["counts"])
    if emitter:
        yield from emitter.finish(key[1] == 0)


def audit(
    df: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", *,
    least_docs: int = 30, top: int = 50,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: ``pair`` rows for every other source of the language, ``term`` rows for
    the ``top`` terms that the source uses more than its language."""
    docs = spread_out(df.select(
        text_or_empty(lang_column).alias("lang"), text_or_empty(source_column).alias("source"), text_or_empty(text_column).alias("text"),
    ))
    folded = docs.mapInArrow(fold_documents, STRIPE)
    ordered = folded.repartition("lang", "term").sortWithinPartitions("lang", "term")
    kept = materialize(ordered.mapInArrow(lambda batches: merge_stripes(batches, least_docs), STRIPE), "stripes")

    entries = kept.select("lang", "term", F.inline(F.arrays_zip("sources", "counts")))
    of_term = F.when(F.col("term") != "", F.col("counts")).otherwise(0)
    groups = entries.groupBy("lang", F.col("sources").alias("source")).agg(F.sum(of_term).alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("terms"))
    pieces = F.greatest(F.ceil(F.col("terms") / PART_TERMS), F.lit(1)).cast("int")
    langs = materialize(langs.withColumn("pieces", pieces), "langs")
    stripes = kept.where("term <> ''").join(langs, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "pieces").cast("int").alias("piece"), "term", "docs", "sources", "counts"
    )
    heads = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(None).cast("string").alias("term"),
        F.col("terms").alias("docs"), F.array("source").alias("sources"), F.array("total").alias("counts"),
    )
    laid = heads.unionByName(stripes).repartition("lang", "piece").sortWithinPartitions("lang", "piece", F.asc_nulls_first("term"))
    found = laid.mapInArrow(lambda batches: emit_divergences(batches, top), FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))
