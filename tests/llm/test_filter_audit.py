"""The filter audit against filters that are really applied in every order, and its cases."""

import itertools
import random
import re
from collections import defaultdict

from annolytics.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    labels = [r for r in labels if r[0] is not None]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}

    def fails(doc, text):
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        repeat = text in first and (doc is None or doc > first[text])
        conditions = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": repeat,
        }
        return {x for x, c in conditions.items() if c}

    parts = defaultdict(list)
    for doc, text, lang in rows:
        parts[lang or ""].append((doc, fails(doc, text)))
    out = []
    for part, docs in parts.items():
        shapley, found = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                found.append([
                    part, "".join(order), step, len(left), len(gone), sum(x in f for _, f in docs) - len(gone), sum(f == {x} for _, f in docs),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def result(spark, rows, labels):
    df = filter_audit.audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS))
    return sorted(map(tuple, df.collect()))


def made(seed, n):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{draw.randrange(draw.choice([30, 4000]))}" for _ in range(draw.choice([5, 99, 100, 150]))]
        if draw.random() < 0.3:
            words = [w.upper() if draw.random() < 0.5 else w for w in words]
        if draw.random() < 0.3:
            words.append(draw.choice("#$%&*|"))
        rows.append((i, draw.choice(" \t\n").join(words), draw.choice(["en", "en", "de", None])))
    rows += [(n + i, rows[draw.randrange(20)][1], draw.choice(["en", "de"])) for i in range(40)]
    draw.shuffle(rows)
    return rows


def test_against_filters_applied_in_every_order(spark):
    rows = made(1, 150)
    labels = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 190, 2)]
    assert result(spark, rows, labels) == plain(rows, labels)


def test_null_empty_repeated_and_long(spark):
    long = "word " * 200_000
    rows = [(1, None, None), (2, "", ""), (2, "", "en"), (None, "", "en"), (None, "x", "en"), (5, "x", "en"), (7, long, "en"), (6, long, "de"), (7, long, "en")]
    labels = [(2, 1, 0), (2, 0, 1), (99, 1, 1), (None, 1, 1), (7, None, 1)]
    assert result(spark, rows, labels) == plain(rows, labels)


def test_white_space_is_ascii_only(spark):
    rows = [(1, "a b c\x0b\x0cd\x1ce", "en"), (2, " \t\r\n ", "en"), (3, "É" * 40 + "AB", "en")]
    assert result(spark, rows, []) == plain(rows, [])


def test_empty_tables_and_clashing_columns(spark):
    assert result(spark, [], []) == []
    rows, labels = made(2, 40), [(1, 1, 1)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA + ", _mask int, part int, quality int")
    extra = spark.createDataFrame([(*r, "x", "y") for r in labels], LABELS + ", text string, lang string")
    assert sorted(map(tuple, filter_audit.audit(df, extra).collect())) == plain(rows, labels)


def test_swaps_reach_every_order_once_and_share_nodes():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for place in filter_audit.adjacent_orders(n):
            order[place], order[place + 1] = order[place + 1], order[place]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))
    diagram = filter_audit.Diagram({0: (4, 1, 0)}, 5)
    assert len(diagram.nodes) == 11  # two leaves; on each level but the first a node with and one without documents
    before = diagram.root
    for level in (2, 2):
        diagram.swap(level)
    assert diagram.root == before


def test_labels_of_one_document_are_not_multiplied(spark):
    rows, labels = made(4, 30), [(i, 1, 1) for i in range(30)] * 3
    assert result(spark, rows, labels) == plain(rows, labels)
