"""Filter interaction audit: what every order of a set of filters keeps, removes and loses, by decision diagrams.

Each document gets the mask of the filters that it fails. Masks are counted per part, with the good and the toxic
documents among them, so at most 2^m rows of a part go on, however many documents it has. For each part the counts form
a decision diagram: a level for each filter, a pass and a fail branch at every node, counts at the leaves, equal nodes
shared. A node weighs what lies below it. The orders of the filters are visited so that each differs from the one
before by two neighbours (Steinhaus, Johnson and Trotter); swapping two neighbouring levels rebuilds the nodes of these
two levels only. In the diagram of an order the path on which all filters pass holds its steps: at each level the fail
branch weighs what that filter removes and the pass branch what is kept.

Defined cases: a null text is empty; a null part is the empty string; a document whose id is null is a repeat of an
equal text with an id, and never makes another one a repeat; equal rows are separate documents, and equal texts of one
id are no repeats of each other; several labels of one document count as one that is good (toxic) if any says so;
labels without document are left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.common import spread_out, text_or_empty
from annolytics.operators.relational import join_on, salted_lookup
from annolytics.session import materialize

Counts = tuple[int, int, int]  # documents, good ones, toxic ones
Node = tuple  # (pass branch, fail branch), or Counts at a leaf

NONE: Counts = (0, 0, 0)
WHITE = r"[\x20\x09-\x0D]+"
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def add(a: Counts, b: Counts) -> Counts:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def adjacent_orders(n: int) -> Iterator[int]:
    """Places to swap so that all n! orders of n things come up, each from the one before by two neighbours."""
    order, moves = list(range(n)), [-1] * n
    while True:
        free = [
            x for x in range(n) if 0 <= (to := order.index(x) + moves[x]) < n and order[to] < x
        ]
        if not free:
            return
        largest = free[-1]
        at = order.index(largest)
        to = at + moves[largest]
        order[at], order[to] = order[to], order[at]
        for x in range(largest + 1, n):
            moves[x] = -moves[x]
        yield min(at, to)


class Diagram:
    """A count-weighted decision diagram over ``levels`` filters; nodes are interned, so equal ones are one."""

    def __init__(self, masks: Mapping[int, Counts], levels: int) -> None:
        self.levels = levels
        self.nodes: dict[Node, Node] = {}
        self.weights: dict[int, Counts] = {}
        layer = [self._shared(masks.get(mask, NONE)) for mask in range(1 << levels)]  # bit i of a mask is level i
        for level in reversed(range(levels)):
            half = 1 << level
            layer = [self._shared((layer[m], layer[m + half])) for m in range(half)]
        self.root = layer[0]

    def _shared(self, node: Node) -> Node:
        return self.nodes.setdefault(node, node)

    def weight(self, node: Node, level: int) -> Counts:
        """Counts of all leaves below a node."""
        if level == self.levels:
            return node
        if id(node) not in self.weights:
            self.weights[id(node)] = add(self.weight(node[0], level + 1), self.weight(node[1], level + 1))
        return self.weights[id(node)]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next one: the two middle grandchildren of their nodes change places."""
        done: dict[int, Node] = {}

        def rebuilt(node: Node, at: int) -> Node:
            if id(node) not in done:
                if at == level:
                    (pp, pf), (fp, ff) = node
                    done[id(node)] = self._shared((self._shared((pp, fp)), self._shared((pf, ff))))
                else:
                    done[id(node)] = self._shared((rebuilt(node[0], at + 1), rebuilt(node[1], at + 1)))
            return done[id(node)]

        self.root = rebuilt(self.root, 0)

    def steps(self) -> list[tuple[Counts, Counts]]:
        """Along the path on which all pass: what the pass branch keeps and the fail branch removes at each level."""
        node, out = self.root, []
        for level in range(self.levels):
            out.append((self.weight(node[0], level + 1), self.weight(node[1], level + 1)))
            node = node[0]
        return out


def audit_of(masks: Mapping[int, Counts], letters: str) -> list[tuple]:
    """A row for each order and step: order, step, kept, removed, redundant, unique fails, good lost, toxic lost, Shapley sum."""
    n = len(letters)
    diagram, order = Diagram(masks, n), list(letters)
    seen = [(tuple(order), diagram.steps())]
    for place in adjacent_orders(n):
        diagram.swap(place)
        order[place], order[place + 1] = order[place + 1], order[place]
        seen.append((tuple(order), diagram.steps()))
    fails, alone, shapley = {}, {}, dict.fromkeys(letters, 0)
    for order, steps in seen:
        fails[order[0]], alone[order[-1]] = steps[0][1][0], steps[-1][1][0]  # nothing, or all others, went before
        for letter, (_, removed) in zip(order, steps):
            shapley[letter] += removed[0]
    return [
        ("".join(order), i, kept[0], gone[0], fails[x] - gone[0], alone[x], gone[1], gone[2], shapley[x])
        for order, steps in seen for i, (x, (kept, gone)) in enumerate(zip(order, steps), 1)
    ]


def mask_of(filters: Mapping[str, Column]) -> Column:
    """Bit i is set where the i-th filter's failure condition holds; null counts as passing."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())]
    return sum(bits[1:], bits[0])


def text_filters(text: str, repeated: Column) -> dict[str, Column]:
    """A: short; B: few distinct words; C: capitals; D: symbols; E: ``repeated``. ``_words`` and ``_distinct`` are counts."""
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.col("_words") < 100, "B": F.col("_distinct") * 100 < F.col("_words") * 80,
        "C": capitals * 100 > F.char_length(text) * 10, "D": F.col(text).rlike("[#$%&*|]"), "E": repeated,
    }


def masks(df: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """``_id, _part, _mask``. Texts are read once; for the repeats ids and digests are shuffled, those of a frequent text in parts."""
    rows = spread_out(df.select(
        F.col(id_column).alias("_id"), text_or_empty(part_column).alias("_part"), text_or_empty(text_column).alias("_text")
    ))
    words = F.filter(F.split("_text", WHITE), lambda w: w != "")
    rows = rows.withColumn("_list", words).withColumns({
        "_words": F.size("_list").cast("long"), "_distinct": F.size(F.array_distinct("_list")).cast("long"),
    })
    own = materialize(rows.select(
        "_id", "_part", mask_of(text_filters("_text", F.lit(False))).alias("_mask"), F.unhex(F.sha2("_text", 256)).alias("_digest"),
    ), "masks")
    same = own.groupBy("_digest").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    same = materialize(same.where("_n > 1 and _least is not null"), "repeats")
    later = F.col("_least").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_least")))
    found = salted_lookup(own, same.drop("_n"), "_digest", same.select("_digest", "_n"))
    return found.select("_id", "_part", (F.col("_mask") + F.when(later, 16).otherwise(0)).alias("_mask"))


def audit(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """Every part, order and step of the five text filters; see the module's head for the columns."""
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic")
    )
    marked = join_on(masks(df, id_column, text_column, part_column), marks, ["_id"], "left")
    return orders(marked, "ABCDE")


def orders(marked: DataFrame, letters: str) -> DataFrame:
    """The audit of ``_part, _mask, _good, _toxic`` rows, where bit i of the mask is the i-th letter."""
    counted = marked.groupBy("_part", "_mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_good").alias("good"), F.count_if("_toxic").alias("toxic")
    )

    def run(table: pa.Table) -> pa.Table:  # at most 2^m rows
        rows = table.to_pylist()
        found = audit_of({r["_mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}, letters)
        columns = [[rows[0]["_part"]] * len(found), *map(list, zip(*found))]
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])

    return counted.groupBy("_part").applyInArrow(run, RESULT)
