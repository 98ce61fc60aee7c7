"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of vectors (at most ``SAMPLE``, the first by a hash of their id) gives a graph of nearest
   neighbours, which is cut in balanced parts: vectors start in balanced parts along random directions, then move to the
   part that holds most of their neighbours while it has room, in several sweeps.
2. A small network learns to name the part of a vector. It places every vector in its most probable part, and sends a
   query to its several most probable ones; how many is set by the recall that held-out rows of the sample reach.
3. There the query meets all vectors of the part. Parts are cut in cells of about ``CELL`` vectors and ``BATCH`` queries,
   so a large part is many groups; each gives its best candidates, scored in double precision on the original vectors,
   and the best of all cells are the answer. Each vector lies in one part only, so no candidate comes twice.

The number of parts follows the number of vectors up to ``PARTS``, which the sample bounds.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; rows of a repeated id are separate candidates and separate queries, and a query passes over its own row only, so an
id asked for on several rows has ranks for each of them; queries with fewer candidates than asked for get all that their parts hold, and all there are in tables small enough for one part; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.common import column_of, first_by_hash
from annolytics.session import materialize

SAMPLE, PARTS, PER_PART = 8192, 128, 1000
CELL, BATCH = 2048, 512


def units(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest other rows of each row, in blocks."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for start in range(0, len(x), 512):
        near = x[start : start + 512] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        out[start : start + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12) -> np.ndarray:
    """Part of each row: at most a tenth more rows in a part than on average."""
    part, room = np.zeros(len(x), np.int64), int(np.ceil(1.1 * len(x) / parts))
    pieces = [(np.arange(len(x)), parts)]
    number = 0
    while pieces:  # halves along the direction between two far means, sized to the parts they will hold
        rows, share = pieces.pop()
        if share == 1:
            part[rows] = number
            number += 1
            continue
        centre = x[rows[rng.integers(len(rows))]]
        far = x[rows[np.argmin(x[rows] @ centre)]]
        for _ in range(4):
            side = x[rows] @ (centre - far)
            cut = np.argsort(-side, kind="stable")
            left = len(rows) * (share // 2) // share
            centre, far = x[rows[cut[:left]]].mean(axis=0), x[rows[cut[left:]]].mean(axis=0)
        pieces += [(rows[cut[:left]], share // 2), (rows[cut[left:]], share - share // 2)]
    source = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = np.concatenate((np.stack((source, graph.ravel()), axis=1), np.stack((graph.ravel(), source), axis=1)))
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    sizes = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for start in range(0, len(x), 256):  # votes of a block at once, moves one by one
            stop = min(start + 256, len(x))
            lo, hi = np.searchsorted(ends[:, 0], [start, stop])
            cell = (ends[lo:hi, 0] - start) * parts + part[ends[lo:hi, 1]]
            votes = np.bincount(cell, minlength=(stop - start) * parts).reshape(-1, parts)
            for i in np.nonzero(votes.max(axis=1) > votes[np.arange(stop - start), part[start:stop]])[0]:
                best = int(np.where(sizes < room, votes[i], -1).argmax())
                if votes[i, best] > votes[i, part[start + i]]:
                    sizes[part[start + i]] -= 1
                    sizes[best] += 1
                    part[start + i] = best
                    moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer that gives the log probability of each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def trained(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> Router:
    """Cross-entropy by Adam over shuffled batches."""
    weights = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
        rng.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            a, y = x[rows], part[rows]
            h = np.maximum(a @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            p /= len(rows)
            d = (p @ weights[2].T) * (h > 0)
            step += 1
            for w, g, (m, v) in zip(weights, (a.T @ d, d.sum(axis=0), h.T @ p, p.sum(axis=0)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(*[w.astype(np.float32) for w in weights])


def fit(sample: np.ndarray, parts: int, recall: float, k: int, seed: int = 0) -> tuple[Router, int]:
    """The router, fitted on three quarters of the sample, and how many parts to probe.

    The last quarter asks for its k nearest among the whole sample; the number of parts is the smallest with which
    ``recall`` of these are met. Neighbours in a sample are further away than among all vectors, so this errs upwards.
    """
    rng = np.random.default_rng(seed)
    x = units(sample)
    own = x[: len(x) * 3 // 4]
    router = trained(own, balanced_parts(own, neighbour_graph(own), parts, rng), parts, rng)
    scores = router.scores(x)
    asks = np.arange(len(own), len(x))
    near = x[asks] @ x.T
    near[np.arange(len(asks)), asks] = -np.inf
    near = np.argpartition(-near, k, axis=1)[:, :k]
    place = np.argsort(np.argsort(-scores[asks], axis=1, kind="stable"), axis=1)  # of each part in a query's order
    needed = np.take_along_axis(place, scores.argmax(axis=1)[near], axis=1)
    met = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    return router, int(np.searchsorted(met, recall)) + 1


def usable(vector: str, length: int | None = None) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(found & (F.size(vector) == length) if length else found, F.lit(False))


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by descending score, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search(
    df: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding", *, k: int = 5,
    recall: float = 0.96, seed: int = 0,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows for which ``queries`` holds; ``recall`` is what probing aims at."""
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull())
    common = rows.where(usable("v")).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = dict(df.dtypes)[id_column]
    if common is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows, count = rows.where(usable("v", common.n)), common["count"]
    sample = first_by_hash(rows.select("id", "v"), F.xxhash64("id"), SAMPLE, "id").collect()
    parts = int(np.clip(count // PER_PART, 1, min(PARTS, max(1, len(sample) // 64))))
    vectors = np.array([r.v for r in sample])
    router, tries = fit(vectors / np.abs(vectors).max(axis=1, keepdims=True), parts, recall, k, seed) if parts > 1 else (None, 1)
    tries = min(tries, parts)
    sent = df.sparkSession.sparkContext.broadcast(router)

    def route(batches):
        for batch in batches:
            x = np.array(column_of(batch, "v"), float).reshape(batch.num_rows, -1)
            # scaled first, so that no component overflows or vanishes in single precision
            z = sent.value.scores(units(x / np.abs(x).max(axis=1, keepdims=True))) if router else np.zeros((len(x), 1))
            order = np.argsort(-z, axis=1, kind="stable")[:, :tries]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32()))], names=["id", "v", "q", "row", "parts"]
            )

    marked = rows.withColumn("row", F.monotonically_increasing_id())
    placed = materialize(marked.mapInArrow(route, f"id {kind}, v array<double>, q boolean, row long, parts array<int>"), "placed")
    own = F.col("parts")[0]
    sizes = placed.groupBy(own.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a part
    asked = placed.where("q").select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    cells = {r.part: -(-r.n // CELL) for r in sizes}
    piles = {r.part: -(-r.n // BATCH) for r in asked}
    table = lambda found, part: F.element_at(F.array(*[F.lit(found.get(p, 0)) for p in range(parts)]), part + 1)
    turn = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
    none = F.array().cast("array<int>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    vectors = placed.select("id", "row", "v", own.alias("part"), F.lit(False).alias("asks")).withColumns({
        "cell": turn(table(cells, F.col("part"))), "pile": F.explode(upto(table(piles, F.col("part")))),
    })
    probing = placed.where("q").select("id", "row", "v", F.explode("parts").alias("part"), F.lit(True).alias("asks")).withColumns({
        "pile": turn(table(piles, F.col("part"))), "cell": F.explode(upto(table(cells, F.col("part")))),
    })

    def compare(table):
        asks = table.column("asks").to_numpy()
        ids, rows = table.column("id").to_numpy(), table.column("row").to_numpy()
        v = np.array(table.column("v").to_pylist(), float).reshape(len(ids), -1)
        scaled = v / np.abs(v).max(axis=1, keepdims=True)
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        out = ([], [], [], [])
        theirs, mine = unit[~asks], unit[asks]
        if len(theirs) and len(mine):
            rough = mine @ theirs.T
            rough[rows[asks][:, None] == rows[~asks][None, :]] = -np.inf
            keep = min(k, len(theirs))
            floor = np.partition(rough, len(theirs) - keep, axis=1)[:, len(theirs) - keep]
            for i, query in enumerate(ids[asks].tolist()):
                near = np.nonzero((rough[i] >= floor[i] - 1e-9) & (rough[i] > -np.inf))[0]
                score = np.clip((theirs[near] * mine[i]).sum(axis=1), -1.0, 1.0)
                best = best_rows(score, ids[~asks][near], k)
                out[0].extend([query] * len(best))
                out[1].extend(ids[~asks][near][best].tolist())
                out[2].extend(score[best].tolist())
                out[3].extend([rows[asks][i]] * len(best))
        return pa.table({"query_id": pa.array(out[0], table.schema.field("id").type), "vec_id": pa.array(out[1], table.schema.field("id").type), "score": pa.array(out[2], pa.float64()), "row": pa.array(out[3], pa.int64())})

    found = vectors.unionByName(probing).groupBy("part", "cell", "pile").applyInArrow(
        lambda t: compare(t), f"query_id {kind}, vec_id {kind}, score double, row long"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


