"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns ``a`` and ``b``): nodes with one root are connected.

    Each round moves every node to the smallest of itself and its neighbours and draws the links anew between the
    places reached, until no link is left. With nodes named by digests the graph shrinks by a constant factor each
    round. Every round is written to the shared folder, nothing is gathered, and a node with many links is only the
    key of a minimum (summed up on the map side) and of a join of two written tables, which adaptive execution splits.
    """
    links = materialize(
        links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    moves = []
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = materialize(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "moves")
        moves.append(move)
        before = links
        links = materialize(
            links.join(move.withColumnRenamed("to", "x"), "a")
            .join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links",
        )
        discard(before)
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    reached = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in moves[1:]:
        reached = reached.join(move.select(F.col("a").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    reached = materialize(reached, "components")
    discard(*moves)
    return reached
