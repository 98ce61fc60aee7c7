"""Sharding on a consistent-hash ring with virtual nodes and bounded loads: shards whose row counts differ by one at most.

Every shard stands at ``vnodes`` places of a ring of 2^60 positions, a key at the position of its hash. A key belongs to
the first place clockwise from it; keys are taken in the order of the ring, and one whose shard is full continues
clockwise to the next shard with room. The first ``rows mod shards`` shards of the list take one row more than the others,
so the shards fill up exactly. While shards fill evenly none is full before the last stretch of the ring: keys before it
stay at home whatever the load is, so one more shard moves its own keys and some of that stretch.

The keys between two neighbouring places are an arc. Which keys of an arc go where follows from the counts of the arcs
alone, a table of ``shards * vnodes`` rows at most; every row then finds its shard and its slot there by arithmetic from
its number inside the arc. Numbering goes by slices of the sorted keys, so an arc may hold any share of the rows, and only
ids, sizes and checksums move unless further columns are asked for.

Defined cases: a null text has no bytes and the checksum of the empty text; null ids share one position, as repeated ids
do; equal rows are separate rows, each with a slot of its own; with fewer rows than shards the last shards stay empty; an
empty table gives no rows; other columns are kept where asked for, and clashing names do no harm.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import text_or_empty
from annolytics.operators.windows import number_rows

VNODES = 128
DIGITS = 15  # hexadecimal digits of a position
HEAD = 8  # bytes that a row takes besides its text


def position(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:DIGITS], 16)


def key_position(id_column: Column) -> Column:
    """The position of a key on the ring, as :func:`position` gives it for the id as text."""
    digest = F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def places(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes in the order of the ring; arc i ends at place i."""
    return sorted((position(f"{s}:{v}"), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: Mapping[int, int], ring: Sequence[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """``(arc, first, shard, slot)``: from number ``first`` on, keys of the arc go to ``shard`` from ``slot`` on.

    Each entry ends its arc or fills its shard, so there are at most as many as arcs with keys and shards together.
    """
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    # the next place clockwise whose shard may have room; places of full shards are skipped for good
    onward = list(range(len(ring) + 1))

    def open_place(at: int) -> int:
        path = []
        while onward[at] != at or (at < len(ring) and not room[ring[at][1]]):
            path.append(at)
            if onward[at] == at:
                onward[at] = at + 1
            at = onward[at]
        for passed in path:
            onward[passed] = at
        return at

    for arc in sorted(counts):
        first, left = 0, counts[arc]
        while left:
            at = open_place(arc)
            if at == len(ring):
                at = open_place(0)
            shard = ring[at][1]
            taken = min(left, room[shard])
            yield arc, first, shard, used[shard]
            first, left = first + taken, left - taken
            room[shard] -= taken
            used[shard] += taken


def place(
    df: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", *, vnodes: int = VNODES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, then the columns of ``keep``.

    ``size`` is the bytes of the text and 8 more. Slots number the rows of a shard from 0 in the order of filling. The
    law is ``rows``; ``grown_shard`` belongs to another law and is null.
    """
    spark = df.sparkSession
    ring = places(shards, vnodes)
    ends = np.array([at for at, _ in ring], np.int64)

    @F.pandas_udf("int")
    def arc_of(positions: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, positions.to_numpy(), side="left") % len(ends)).astype("int32")

    text = text_or_empty(text_column).cast("binary")
    rows = df.select(
        F.col(id_column).alias("_id"), (F.octet_length(text) + HEAD).cast("long").alias("_size"), F.crc32(text).cast("long").alias("_crc"),
        key_position(F.col(id_column)).alias("_at"), F.struct(*keep).alias("_kept") if keep else F.lit(0).alias("_kept"),
    ).withColumns({"_arc": arc_of("_at"), "_tie": F.monotonically_increasing_id()})
    numbered = number_rows(rows, ["_at", "_id", "_size", "_crc", "_tie"], ["_arc"], "_number")
    counts = {r[0]: r[1] for r in numbered.groupBy("_arc").count().collect()}  # a row an arc
    found: dict[int, list] = {}
    for arc, first, shard, slot in fill(counts, ring, shards):
        found.setdefault(arc, []).append((first, shard, slot))
    spans = spark.createDataFrame(list(found.items()), "_arc int, _spans array<struct<first:long,shard:int,slot:long>>")
    at = F.element_at(F.filter("_spans", lambda s: s["first"] < F.col("_number")), -1)  # numbers start at 1
    placed = numbered.join(F.broadcast(spans), "_arc").withColumn("_span", at)  # at most a row an arc
    return placed.select(
        F.col("_id").alias(id_column), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_span.shard").alias("shard"), (F.col("_span.slot") + F.col("_number") - 1 - F.col("_span.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_kept.`{c}`").alias(c) for c in keep],
    )


def write_shards(df: DataFrame, folder: str, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", **options) -> None:
    """Write the rows of ``df`` as Parquet, a folder ``shard=N`` for each shard and its rows in the order of their slots.

    Rows are range-partitioned by shard and slot, so several tasks write a large shard, each a file of its own whose name
    sorts by slot.
    """
    names = {c.lower() for c in df.columns}
    if taken := names & {"shard", "slot"}:
        raise ValueError(f"columns {sorted(taken)} are those that a shard's files carry")
    marked = df.select(F.struct(*df.columns).alias("_row"), F.col(id_column).alias("_key"), F.col(text_column).alias("_body"))
    placed = place(marked, shards, "_key", "_body", keep=["_row"], **options)
    laid = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    laid.select("shard", "slot", "_row.*").write.partitionBy("shard").parquet(folder)


def home(name: str, ring: Sequence[tuple[int, int]]) -> int:
    """The place clockwise from a key."""
    return bisect.bisect_left(ring, (position(name), -1)) % len(ring)
