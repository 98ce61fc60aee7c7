"""SentencePiece BPE with seeded merge-dropout, and the decoder that gives the text back.

The pieces and their ranks come from a published model file; nothing is trained. A text is cut in front of its words
(no piece of such a model crosses a word's start), and every word is merged by an agenda: the best-ranked candidate
merge first, the leftmost of equals. A candidate taken from the agenda is skipped when a hash of (seed, document, number
of the word in its text, start, end) falls under the dropout rate: the same seed always gives the same pieces, while every
occurrence of a word is cut anew.

The agendas of many words run side by side: a column of an array holds the ranks of one word's candidates, and each turn
takes the best of every column, draws, merges, and looks the new neighbours' ranks up in a table of pairs. Parts of more
than ``WIDE`` characters run alone, with a heap.

Spaces are written as U+2581 as usual. A U+2581 that the text itself holds, and any character without a piece, goes
through byte pieces, so decoding is lossless for every text.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows give equal ids; ``variant``
is the hash of seed and id that the draws of a document depend on, 0 for a null id; extra columns are not carried unless
named in ``keep``. Very long texts are encoded in pieces cut before words, which changes no id.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from annolytics.llm.common import column_of, slices, spread_out, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Longer words are cut where two neighbours stand in no piece together.
WHOLE_CHARS = 24
#: Agendas of parts of up to this many characters run side by side, so many at a time.
WIDE, BATCH_UNITS = 31, 16_384
#: Characters that are encoded together.
BATCH_CHARS = 1 << 20
#: Longer parts use a heap.
SHORT_PART = 48


ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Of the draws; a candidate enters as ``start * START + end * END``.
START, END, DRAW, DRAW2 = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE3D, 0x27D4EB2F


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


NO_MERGE = np.int32(2**31 - 1)
OWN_SPACE = 0x110000  # code of a U+2581 that the text itself holds


class PairTable:
    """A number for some pairs of symbols. Pairs that fall on a taken slot go to the next level."""

    def __init__(self, pairs: dict[tuple[int, int], int], symbols: int):
        self.width = symbols + 1
        keys = np.array([left * self.width + right for left, right in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        self.levels = []
        while True:
            bits = max(len(keys) * 4, 2).bit_length()
            slots = self._slots(keys, bits)
            _, first = np.unique(slots, return_index=True)
            stored, numbers, more = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_MERGE, np.int32), np.zeros(1 << bits, bool)
            stored[slots[first]], numbers[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            more[slots[rest]] = True
            self.levels.append((bits, stored, numbers, more))
            keys, values = keys[rest], values[rest]
            if not len(keys):
                break

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * ODD >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of pairs of symbols (-1: none), ``NO_MERGE`` where the table has none."""
        keys = left.astype(np.int64) * self.width + right
        out = np.full(len(keys), NO_MERGE, np.int32)
        at = slice(None)
        for bits, stored, numbers, more in self.levels:
            slots = self._slots(keys, bits)
            hit = stored[slots] == keys
            found = np.where(hit, numbers[slots], NO_MERGE)
            if isinstance(at, slice):
                out = found
                at = np.flatnonzero(~hit & more[slots])
                keys = keys[at]
            else:
                out[at] = found
                rest = ~hit & more[slots]
                at, keys = at[rest], keys[rest]
            if not len(at):
                break
        return out


class MergeDropout:
    """Encoder and decoder over the pieces of one model file."""

    def __init__(self, model: str = MODEL, rate: float = 0.1, seed: int = 0):
        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        size = pieces.get_piece_size()
        plain = [i for i in range(size) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))]
        by_rank = sorted(plain, key=lambda i: (-pieces.get_score(i), i))
        self.rank = {pieces.id_to_piece(i): r for r, i in enumerate(by_rank)}
        self.id_at = by_rank
        self.bytes_of = {i: pieces.id_to_piece(i).replace(SPACE, " ").encode() for i in plain}
        self.byte_ids = [0] * 256
        for i in range(size):
            if pieces.is_byte(i):
                value = int(pieces.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
        self.limit, self.seed = int(rate * (1 << 32)), seed
        self.inside = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self._make_tables()

    def _make_tables(self) -> None:
        """Symbols are the pieces by rank, then the characters that stand in pieces but are none."""
        symbol = dict(self.rank)
        for char in sorted({c for piece in self.rank for c in piece}):
            symbol.setdefault(char, len(symbol))
        self.of_char = np.full(OWN_SPACE + 1, -1, np.int32)
        for text, number in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = number
        halves = ((symbol.get(p[:i]), symbol.get(p[i:]), r) for p, r in self.rank.items() for i in range(1, len(p)))
        self.merges = PairTable({(x, y): r for x, y, r in halves if x is not None and y is not None}, len(symbol))
        self.joined = PairTable({(symbol[p[0]], symbol[p[1]]): 1 for p in self.inside}, len(symbol))
        self.ids = np.array(self.id_at, np.int32)
        top = max(self.bytes_of) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def skipped(self, key: int, start: int, end: int) -> bool:
        draw = (key ^ (start * START + end * END)) * DRAW & 0xFFFFFFFF
        return (draw ^ draw >> 15) * DRAW2 & 0xFFFFFFFF < self.limit

    def spans_of_short(self, word: str, key: int) -> list[int]:
        """Starts of the pieces. The agenda is the list of the neighbours' ranks; ``none`` marks what cannot merge."""
        rank, limit, none = self.rank.get, self.limit, len(self.rank)
        starts = list(range(len(word) + 1))
        agenda = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            if limit and self.skipped(key, starts[i], starts[i + 2]):
                agenda[i] = none
                continue
            del starts[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(word[starts[i - 1] : starts[i + 1]], none)
            if i < len(agenda):
                agenda[i] = rank(word[starts[i] : starts[i + 2]], none)
        return starts

    def spans_of_long(self, word: str, key: int) -> list[int]:
        """The same with a heap of (rank, start, end); candidates that no longer fit the chain are passed over."""
        rank, limit, n = self.rank, self.limit, len(word)
        ends, starts = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that begins / ends at a place
        agenda = [(rank[pair], i, i + 2) for i in range(n - 1) if (pair := word[i : i + 2]) in rank]
        heapify(agenda)
        while agenda:
            _, start, end = heappop(agenda)
            middle = ends[start]
            if not 0 < middle < end or ends[middle] != end or limit and self.skipped(key, start, end):
                continue
            ends[start], ends[middle], starts[end] = end, 0, start
            if start and (r := rank.get(word[starts[start] : end])) is not None:
                heappush(agenda, (r, starts[start], end))
            if end < n and (r := rank.get(word[start : ends[end]])) is not None:
                heappush(agenda, (r, start, ends[end]))
        out = [0]
        while out[-1] < n:
            out.append(ends[out[-1]])
        return out

    def ids_of(self, part: str, starts: list[int]) -> list[int]:
        ids = []
        for start, end in pairwise(starts):
            r = self.rank.get(part[start:end])
            if r is None:
                ids += [self.byte_ids[b] for b in part[start:end].encode()]
            else:
                ids.append(self.id_at[r])
        return ids

    def merged(self, part: str, key: int) -> list[int]:
        """Ids of one part of a word, without its tree."""
        return self.ids_of(part, (self.spans_of_short if len(part) <= SHORT_PART else self.spans_of_long)(part, key))

    def parts_of(self, word: str) -> list[str]:
        """A long word falls into parts where two neighbours stand in no piece together."""
        cut = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        return [word[start:end] for start, end in pairwise(cut)]

    def units(self, text: str) -> list[str]:
        """The words of a text, long ones in parts; the empty word stands for a U+2581 of the text itself."""
        out: list[str] = []
        for number, part in enumerate(text.split(SPACE)):
            if number:
                out.append("")
            part = part.replace(" ", SPACE)
            for word in WORD.findall(part if number else SPACE + part):
                if len(word) <= WHOLE_CHARS:
                    out.append(word)
                else:
                    out += self.parts_of(word)
        return out

    def keys(self, count: int, variant: int) -> np.ndarray:
        """Of the draws of each word of a document."""
        return self._keys(np.full(count, variant, object), np.arange(1, count + 1))

    def _keys(self, variants: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        distinct = {v: xxh64_intdigest((self.seed * 1_000_003 + v & (1 << 64) - 1).to_bytes(8, "little")) for v in set(variants)}
        keys = np.array([distinct[v] for v in variants], np.uint64) ^ numbers.astype(np.uint64) * ODD
        keys = (keys ^ (keys >> np.uint64(29))) * ODD2
        keys = (keys ^ (keys >> np.uint64(32))) * ODD
        return (keys >> np.uint64(32)).astype(np.uint32)

    def _merge(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        """Run the agendas of the units at ``starts``; ``alive`` marks where pieces begin, ``symbols`` says which."""
        pairs = np.append(self.merges.get(symbols[:-1], symbols[1:]), NO_MERGE)
        order = np.argsort(sizes, kind="stable")
        order = order[np.searchsorted(sizes[order], 2) :]
        for at in range(0, len(order), BATCH_UNITS):
            chunk = order[at : at + BATCH_UNITS]
            self._merge_together(symbols, alive, pairs, starts[chunk], sizes[chunk], keys[chunk])

    def _merge_together(self, symbols, alive, pairs, starts, sizes, keys) -> None:
        width, n = int(sizes.max()), len(starts)
        row = np.arange(width)[:, None]
        places = np.minimum(starts + row, len(symbols) - 1)
        inside = row < sizes
        own, living = symbols[places], inside.copy()
        # the agenda: rank and place of each candidate as one number, a column for each unit
        agenda = pairs[places]
        agenda = np.where((row < sizes - 1) & (agenda != NO_MERGE), agenda * np.int32(32) + row.astype(np.int32), NO_MERGE)
        after = np.repeat(np.arange(1, width + 1, dtype=np.int8)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, width, dtype=np.int8)[:, None], n, axis=1)
        column = np.arange(n)
        while True:
            best = agenda.min(axis=0)
            here = np.flatnonzero(best != NO_MERGE)
            if not len(here):
                break
            if 2 * len(here) < len(column):  # go on with the units that still have candidates
                agenda, column, best = agenda[:, here], column[here], best[here]
                here = np.arange(len(here))
            best, unit = best[here], column[here]
            start = best & 31
            middle = after[start, unit].astype(np.int32)
            end = after[middle, unit].astype(np.int32)
            if self.limit:
                code = start.astype(np.uint32) * np.uint32(START) + end.astype(np.uint32) * np.uint32(END)
                draw = (keys[unit] ^ code) * np.uint32(DRAW)
                skip = (draw ^ draw >> np.uint32(15)) * np.uint32(DRAW2) <= np.uint32(self.limit - 1)
                agenda[start[skip], here[skip]] = NO_MERGE
                take = ~skip
                best, unit, here, start, middle, end = (x[take] for x in (best, unit, here, start, middle, end))
            piece = best >> 5
            own[start, unit], living[middle, unit] = piece, False
            after[start, unit], before[end, unit] = end, start
            agenda[middle, here], agenda[start, here] = NO_MERGE, NO_MERGE
            right = np.flatnonzero(end < sizes[unit])
            previous = before[start, unit].astype(np.int32)
            left = np.flatnonzero(previous >= 0)
            ranks = self.merges.get(
                np.concatenate([piece[right], own[previous[left], unit[left]]]), np.concatenate([own[end[right], unit[right]], piece[left]])
            )
            spot = np.concatenate([start[right], previous[left]])
            agenda[spot, np.concatenate([here[right], here[left]])] = np.where(ranks != NO_MERGE, ranks * np.int32(32) + spot, NO_MERGE)
        symbols[places[inside]] = own[inside]
        alive[places[inside]] = living[inside]

    def _starts_of_units(self, codes: np.ndarray, firsts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where units begin, as :meth:`units` cuts; ``firsts`` are the beginnings of the pieces of text."""
        space, other = codes == ord(SPACE), codes == OWN_SPACE
        cut = other.copy()
        cut[1:] |= other[:-1] | space[1:] & ~space[:-1]
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(codes))
        long = np.flatnonzero(sizes > WHOLE_CHARS)
        inner = ranges(starts[long] + 1, sizes[long] - 1)
        cut[inner[self.joined.get(symbols[inner - 1], symbols[inner]) == NO_MERGE]] = True
        return np.flatnonzero(cut)

    def encode_all(self, texts: Sequence[str], variants: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, the ends of each text's ids (after a 0), and whether decoding gives the text."""
        parts, counts, whole = [], np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        group, owners, size, used = [], [], 0, 0

        def flush() -> None:
            nonlocal group, owners, size, used
            if group:
                ids, ends, same, units = self._encode_group(group, owners, variants, used)
                parts.append(ids)
                np.add.at(counts, owners, np.diff(ends))
                np.logical_and.at(whole, owners, same)
                used = units
            group, owners, size = [], [], 0

        for i, text in enumerate(texts):
            used_up = 0
            text = " " + text if text else ""
            while used_up < len(text):
                if used_up == 0 and size + len(text) > BATCH_CHARS or size >= BATCH_CHARS:
                    flush()
                end = len(text)
                if end - used_up > BATCH_CHARS:
                    word = re.compile("(?<! ) ").search(text, used_up + BATCH_CHARS)
                    end = word.start() if word else end
                if used_up == 0 and not group:
                    used = 0
                group.append(text[used_up:end])
                owners.append(i)
                size += end - used_up
                used_up = end
        flush()
        return np.concatenate([np.empty(0, np.int32), *parts]), np.concatenate([[0], np.cumsum(counts)]), whole

    def _encode_group(self, pieces: list[str], owners: list[int], variants: Sequence[int], used: int):
        """Ids, their ends per piece, whether each piece decodes to itself, and the units of the last text so far.

        ``used`` is the number of units that earlier pieces of the first text have had.
        """
        joined = "".join(pieces)
        raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = np.where(raw == 32, ord(SPACE), np.where(raw == ord(SPACE), OWN_SPACE, raw)).astype(np.int32)
        chars = np.array([len(p) for p in pieces])
        firsts = np.cumsum(chars) - chars
        symbols = self.of_char[codes]
        starts = self._starts_of_units(codes, firsts, symbols)
        sizes = np.diff(starts, append=len(codes))
        # units are numbered through all pieces of a text
        new = np.array([i == 0 or owners[i] != owners[i - 1] for i in range(len(pieces))])
        unit_at = np.searchsorted(starts, firsts)
        text_of = np.repeat(np.cumsum(new) - 1, np.diff(unit_at, append=len(starts)))
        numbers = np.arange(len(starts)) - unit_at[new][text_of] + 1 + np.where(text_of == 0, used, 0)
        keys = self._keys(np.array([variants[o] for o, f in zip(owners, new) if f], object)[text_of], numbers)
        alive = np.ones(len(codes), bool)
        short = sizes <= WIDE
        self._merge(symbols, alive, starts[short], sizes[short], keys[short])
        for at in np.flatnonzero(~short).tolist():
            begin, part = int(starts[at]), joined[starts[at] : starts[at] + sizes[at]].replace(" ", SPACE)
            cuts = (self.spans_of_short if len(part) <= SHORT_PART else self.spans_of_long)(part, int(keys[at]))
            alive[begin : begin + len(part)] = False
            for x, y in pairwise(cuts):
                alive[begin + x] = True
                if y > x + 1:
                    symbols[begin + x] = self.rank[part[x:y]]
        found = np.flatnonzero(alive)
        kind = symbols[found]
        plain = (kind >= 0) & (kind < len(self.ids))
        char = raw[found]
        width = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        count = np.where(plain, 1, width)
        to = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[to[plain]] = self.ids[kind[plain]]
        for i in np.flatnonzero(~plain).tolist():
            ids[to[i] : to[i] + count[i]] = [self.byte_ids[b] for b in chr(char[i]).encode()]
        ends = np.concatenate([[0], np.append(to, len(ids))[np.searchsorted(found, firsts + chars)]])
        return ids, ends, self._decodes_to(ids, ends, raw, chars, joined), int(numbers[-1])

    def _decodes_to(self, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, chars: np.ndarray, joined: str) -> np.ndarray:
        """For each piece of text, whether its ids stand for its bytes."""
        sizes = self.sizes[ids]
        given = np.concatenate([[0], np.cumsum(sizes)])[ends]
        width = 1 + (raw >= 0x80).astype(np.int64) + (raw >= 0x800) + (raw >= 0x10000)
        wanted = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(chars)])]
        if not np.array_equal(given, wanted):
            return np.array([
                self.bytes[ranges(self.begins[own], self.sizes[own])].tobytes() == joined[end - n : end].encode()
                for own, n, end in ((ids[a:b], n, end) for (a, b), n, end in zip(pairwise(ends), chars, np.cumsum(chars)))
            ])
        wrong = np.flatnonzero(self.bytes[ranges(self.begins[ids], sizes)] != np.frombuffer(joined.encode(), np.uint8))
        same = np.ones(len(chars), bool)
        same[np.searchsorted(given, wrong, side="right") - 1] = False
        return same

    def encode(self, text: str, variant: int = 0) -> list[int]:
        return self.encode_all([text], [variant])[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids])[1:].decode() if len(ids) else ""


@functools.lru_cache(maxsize=4)
def _encoder(model: str, rate: float, seed: int) -> MergeDropout:
    return MergeDropout(model, rate, seed)


def encode(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, model: str = MODEL, rate: float = 0.1,
    seed: int = 0, keep: Sequence[str] = (),
) -> DataFrame:
    """Ids of every whole text, with the number of ids and whether decoding them gave the text back."""
    wanted = df.select(
        F.col(id_column), F.col(text_column).alias("_text"), *[F.col(c) for c in keep],
        F.when(F.col(id_column).isNull(), 0).otherwise(F.xxhash64(F.lit(seed), F.col(id_column))).alias("variant"),
    )
    out = wanted.drop("_text").withColumns(
        {"n_tokens": F.lit(0).cast("long"), "ids": F.array().cast("array<int>"), "lossless": F.lit(True)}
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model, rate, seed)
        for batch in slices(batches):
            ids, ends, lossless = coder.encode_all(texts_of(batch, "_text"), column_of(batch, "variant"))
            rest = [batch.column(c) for c in out.names[:-3]]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(ends)), lists, pa.array(lossless)], names=out.names)

    return spread_out(wanted).mapInArrow(run, out)


def decode(df: DataFrame, ids_column: str = "ids", name: str = "text", *, model: str = MODEL) -> DataFrame:
    """The texts of id lists; a null list gives the empty text."""
    out = df.drop(name).withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model, 0.0, 0)
        for batch in slices(batches):
            texts = [coder.decode(ids or []) for ids in column_of(batch, ids_column)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in out.names[:-1]], pa.array(texts, pa.string())], names=out.names
            )

    return df.drop(name).mapInArrow(run, out)
