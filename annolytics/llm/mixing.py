"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions alone.

The documents of each source are cut in blocks. With target weight w, the j-th block that a source gives is released
at slot floor((j - 1) / w) and due by slot ceil(j / w). Each slot takes the released block that is due first, the
earlier listed source on ties. As the weights add to one, every block meets its window, so that after any number of
slots each source has given less than one block more or less than its weight asks for.

Weights are fractions of ``period`` slots; the schedule repeats after a period, so one period (a table of ``period``
rows that depends on the weights alone, not on the data) is worked out by a fold, and gives every slot by arithmetic.
A source whose blocks run out before the schedule ends starts over: weights above a source's own share are met by
reading it again, and no document is left out. The schedule ends with the slot in which the last source completes its
first pass.

Sources without a listed weight form one stream named ``rest`` with the weight of ``rest``; sources and streams
without documents have no part, and the other weights are scaled up.

Defined cases: a null source belongs to ``rest``; documents without id are numbered after all others; repeated rows are
separate documents of one stream; an empty table gives an empty schedule; extra columns are kept where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolytics.operators.windows import number_rows
from annolytics.session import materialize

REST = "rest"
PERIOD = 1000
READINGS = 1000  # of a block that one copy of it serves


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Slots of each stream in a period, by largest remainders, at least one each."""
    if not weights:
        return {}
    period = max(period, len(weights))
    total = math.fsum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (exact[s] - slots[s], s))
    left = period - sum(slots.values())
    while left:
        for s in order if left < 0 else reversed(order):
            if left and (left > 0 or slots[s] > 1):
                slots[s] += 1 if left > 0 else -1
                left += -1 if left > 0 else 1
    return slots


def one_period(spark: SparkSession, slots: Mapping[str, int]) -> DataFrame:
    """``_stream, _turn, _at`` of one period: earliest deadline first among the released blocks."""
    streams, period = sorted(slots), sum(slots.values())
    given = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(slots[s]).cast("long").alias("w")) for i, s in enumerate(streams)])
    start = F.struct(
        F.array().cast("array<int>").alias("taken"), F.array_repeat(F.lit(0).cast("long"), len(streams)).alias("done")
    )

    def step(state: Column, t: Column) -> Column:
        due = F.transform(given, lambda g: F.struct(
            (state["done"][g["i"]] * period >= (t + 1) * g["w"]).alias("early"),  # not released by slot t
            F.ceil((state["done"][g["i"]] + 1) * period / g["w"]).alias("deadline"), g["i"].alias("i"),
        ))
        first = F.array_min(due)["i"]
        return F.struct(
            F.concat(state["taken"], F.array(first)).alias("taken"),
            F.transform(state["done"], lambda d, i: d + (i == first).cast("long")).alias("done"),
        )

    whole = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long")), start, step)["taken"]
    names = F.array(*map(F.lit, streams))
    turn = F.row_number().over(Window.partitionBy("_stream").orderBy("_at")).cast("long")
    flat = spark.range(1).select(F.posexplode(whole).alias("_at", "_i"))
    return flat.select(names[F.col("_i")].alias("_stream"), F.col("_at").cast("long")).withColumn("_turn", turn)


def schedule(
    df: DataFrame, weights: Mapping[str, float], id_column: str = "doc_id", source_column: str = "source", *,
    block: int = 16, period: int = PERIOD, rest: float = 0.01, keep: Sequence[str] = (),
) -> DataFrame:
    """Every place of the mixture: ``doc_id, source, stream, block, pass, slot, within, release, deadline``.

    ``block`` numbers the blocks of a stream from 0, ``pass`` its readings from 0, ``slot`` the blocks of the mixture
    from 0, ``within`` the documents of a block. release <= slot < deadline. Inside a stream the order is that of the
    MD5 of the id.
    """
    spark = df.sparkSession
    listed = F.coalesce(F.col("_source").isin([s for s in weights if s != REST]), F.lit(False))
    kept = F.struct(*keep) if keep else F.lit(0)
    rows = df.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), kept.alias("_kept")).withColumns({
        "_stream": F.when(listed, F.col("_source")).otherwise(REST), "_none": F.col("_id").isNull(),
        "_mix": F.md5(F.col("_id").cast("string")),
    })
    numbered = number_rows(rows, ["_none", "_mix", "_id", "_source"], ["_stream"], "_number")
    numbered = materialize(
        numbered.withColumns({
            "_block": F.expr(f"(_number - 1) div {block}"), "_within": F.expr(f"(_number - 1) % {block}"),
        }).drop("_none", "_mix", "_number"), "numbered",
    )
    counts = {r[0]: r[1] for r in numbered.groupBy("_stream").agg(F.max("_block") + 1).collect()}  # a row a listed source
    slots = shares({s: float(weights.get(s, rest)) for s in counts}, period)
    total = sum(slots.values())
    streams = [F.struct(F.lit(s).alias("_stream"), F.lit(n).alias("_blocks"), F.lit(slots[s]).cast("long").alias("_w")) for s, n in counts.items()]
    kind = "array<struct<_stream:string,_blocks:long,_w:long>>"
    sizes = spark.range(1).select(F.inline(F.array(*streams).cast(kind)))  # a row a listed source
    turns = materialize(one_period(spark, slots), "period") if counts else one_period(spark, {REST: 1})  # a row a slot
    # block n - 1, the last that a stream gives for the first time, is the turn (n - 1) % w of period (n - 1) div w
    last = sizes.join(turns, "_stream").where("_turn = (_blocks - 1) % _w + 1").agg(
        F.max(F.expr(f"((_blocks - 1) div _w) * {total} + _at"))
    ).first()[0]
    last = -1 if last is None else last
    # Every slot is a row that knows its stream and, by its turn, its block and the reading of that block. Blocks that are
    # read very often are copied, so that no copy meets more than ``READINGS`` slots.
    sizes = sizes.withColumn("_copies", F.greatest(F.lit(1), F.expr(f"(({last} div {max(total, 1)} + 1) * _w) div (_blocks * {READINGS})")))
    given = spark.range(last + 1).select(F.col("id").alias("_slot"), F.expr(f"id % {max(total, 1)}").alias("_at"), F.expr(f"id div {max(total, 1)}").alias("_round"))
    given = given.join(F.broadcast(turns), "_at").join(F.broadcast(sizes), "_stream").withColumn("_k", F.expr("_round * _w + _turn - 1"))
    given = given.select("_stream", "_slot", "_k", "_w", F.expr("_k % _blocks").alias("_block"), F.expr("_k div _blocks").alias("_pass"), F.expr("(_k div _blocks) % _copies").alias("_copy"))
    copies = numbered.join(F.broadcast(sizes.select("_stream", "_copies")), "_stream")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies").cast("long") - 1)))
    read = copies.join(given, ["_stream", "_block", "_copy"])
    return read.select(
        F.col("_id").alias(id_column), F.col("_source").alias(source_column), F.col("_stream").alias("stream"),
        F.col("_block").alias("block"), F.col("_pass").alias("pass"), F.col("_slot").alias("slot"),
        F.col("_within").alias("within"), F.expr(f"_k * {total} div _w").alias("release"),
        F.expr(f"((_k + 1) * {total} + _w - 1) div _w").alias("deadline"), *[F.col(f"_kept.`{c}`").alias(c) for c in keep],
    )


def _plan_of(marked: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """``_row, _row2, _slot, _within`` of the distinct rows ``_id, _source, _row, _row2``, a row for each reading."""
    plan = schedule(marked, weights, "_id", "_source", keep=["_row", "_row2"], **options)
    return plan.select("_row", "_row2", F.col("slot").alias("_slot"), F.col("within").alias("_within"))


def _marked(df: DataFrame, id_column: str, source_column: str) -> DataFrame:
    """The rows of ``df`` as one struct, so that no name can clash, and two hashes of the whole row that name it."""
    return df.select(
        F.struct(*df.columns).alias("_doc"), F.col(id_column).alias("_id"), F.col(source_column).alias("_source"),
        F.xxhash64(*df.columns).alias("_row"), F.hash(*df.columns).alias("_row2"),
    )


def mix(
    df: DataFrame, weights: Mapping[str, float], id_column: str = "doc_id", source_column: str = "source", **options
) -> DataFrame:
    """The rows of ``df`` in the order of the mixture, those that are read several times once for each reading.

    The order is that of the partitions and of the rows in them; a store that is read back in another order loses it, see
    :func:`places`.
    """
    marked = _marked(df, id_column, source_column)
    plan = _plan_of(marked.select("_id", "_source", "_row", "_row2"), weights, **options)
    same = Window.partitionBy("_row", "_row2").orderBy("_row")  # equal rows are one, which the plan holds once for each
    once = marked.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    mixed = once.join(plan, ["_row", "_row2"])
    return mixed.repartitionByRange("_slot", "_within").sortWithinPartitions("_slot", "_within").select("_doc.*")


def places(
    df: DataFrame, weights: Mapping[str, float], id_column: str = "doc_id", source_column: str = "source", *,
    slot: str = "slot", within: str = "within", **options,
) -> DataFrame:
    """The rows of a mixture that :func:`mix` made, in any order, with the ``slot`` and the place ``within`` it of each.

    The schedule follows from the distinct rows, so it is worked out again; the n-th of equal rows is the n-th reading. A
    row beyond its readings, in a table that is no mixture of distinct rows, has no place (null).
    """
    marked = _marked(df, id_column, source_column)
    distinct = marked.select("_id", "_source", "_row", "_row2").dropDuplicates(["_row", "_row2"])
    plan = _plan_of(distinct, weights, **options)
    # rows and places go to the tasks together, by the name of the row, and meet there: a join would move the texts twice
    kind = marked.schema["_doc"].dataType
    both = marked.select("_row", "_row2", F.lit(True).alias("_is_row"), "_doc", F.lit(None).cast("long").alias("_slot"), F.lit(None).cast("long").alias("_within"))
    both = both.unionByName(plan.select("_row", "_row2", F.lit(False).alias("_is_row"), F.lit(None).cast(kind).alias("_doc"), "_slot", F.col("_within").cast("long")))
    nth = F.row_number().over(Window.partitionBy("_row", "_row2", "_is_row").orderBy("_slot", "_within"))
    both = both.repartition("_row", "_row2").withColumn("_n", nth)
    met = Window.partitionBy("_row", "_row2", "_n")  # one row, one place, or both
    placed = both.withColumns({"_slot": F.max("_slot").over(met), "_within": F.max("_within").over(met)}).where("_is_row")
    return placed.select("_doc.*", F.col("_slot").alias(slot), F.col("_within").alias(within))
