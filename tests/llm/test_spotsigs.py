"""SpotSigs fingerprints against a plain version on small texts."""

import hashlib

import numpy as np
import pytest
from annolytics.llm import spotsigs
from annolytics.llm.queries import QUERIES
from conftest import SMALL

TEXTS = [
    (5, "The cat sat on the mat and looked at the bird."), (3, "The cat sat on the mat and looked at a bird."),
    (9, ""), (7, None), (1, "!!! ???"), (4, "Das Haus ist an der Straße. Ünder 𝔘nicode"), (2, "word " * 3000), (8, "word " * 3000),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def by_hand(rows, wrap=True):
    """Rows by descending id with the next row's text."""
    order = sorted([(i, t or "") for i, t in rows if i is not None], key=lambda r: (-r[0], r[1]))
    signatures = spotsigs.Signatures()
    out = []
    for place, (i, text) in enumerate(order):
        other = order[(place + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = (set(signatures.of(t).tolist()) for t in (text, edited, other))
        like = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(a, b), like(a, c)))
    return out


def result(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()]


def test_neighbours_and_edited_texts(spark):
    assert sorted(result(spotsigs.fingerprint_neighbours(frame(spark, TEXTS)))) == sorted(by_hand(TEXTS))


def test_repeated_ids_null_ids_and_extra_columns(spark):
    rows = [*TEXTS, (5, "another text with the same id"), (5, "another text with the same id")]
    got = spotsigs.fingerprint_neighbours(frame(spark, rows))
    assert sorted(result(got)) == sorted(by_hand(rows))
    lone = frame(spark, [(None, "the lonely text"), (None, None), (1, "the other")]).selectExpr("*", "1 as fingerprint", "2 as _tie")
    found = {(r.doc_id, r.n_chars): r for r in spotsigs.fingerprint_neighbours(lone).collect()}
    assert found[(None, 15)].near_next == 0.0 and found[(None, 0)].near_next == 1.0 and found[(1, 9)].near_next == 1.0


def test_empty_table(spark):
    assert spotsigs.fingerprint_neighbours(frame(spark, [])).collect() == []


def test_many_slices(spark):
    rows = [(i * 7, f"the text number {i} of a list " * (i % 5)) for i in range(300)]
    assert sorted(result(spotsigs.fingerprint_neighbours(frame(spark, rows)))) == sorted(by_hand(rows))


def test_equal_texts_have_equal_fingerprints_and_near_ones_are_near():
    s = spotsigs.Signatures()
    a, b = s.of(TEXTS[0][1]), s.of(TEXTS[1][1])
    assert spotsigs.written(s.of(TEXTS[0][1])) == spotsigs.written(a) and 0.3 < spotsigs.jaccard(a, b) < 1
    assert spotsigs.jaccard(a, b, 0.99) == 0.0 and spotsigs.jaccard(a, a, 0.99) == 1.0
    assert len(s.of("Xyz")) == 1 and len(s.of("...")) == 0


def test_texts_without_anchors_are_seen_whole():
    s = spotsigs.Signatures()
    words = [f"w{i}x" for i in range(60)]
    a = s.of(" ".join(words))
    other = s.of(" ".join(words[:3] + [f"v{i}x" for i in range(57)]))
    assert len(a) > 15 and spotsigs.jaccard(a, other) < 0.1
    for i in range(60):  # an edit anywhere changes some signatures, and few
        edited = s.of(" ".join(words[:i] + ["changed"] + words[i + 1 :]))
        assert 0.5 < spotsigs.jaccard(a, edited) < 1
    tail = " and " + " ".join(words)  # the same after a common word, and with one anchor only
    assert spotsigs.jaccard(s.of("one" + tail), s.of("one" + tail.replace("w50x", "changed"))) < 1


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_pairs_lose_no_link(spark, threshold):
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 32, 40, np.uint64).astype(np.uint32)) for _ in range(6)]
    sets = [*base, base[0]]
    for b in base:
        for drop in (1, 3, 6, 12):
            sets.append(np.unique(np.append(b[drop:], rng.integers(0, 1 << 32, drop // 2, np.uint64).astype(np.uint32))))
    text = sorted({spotsigs.written(x) for x in sets})
    want = {
        (a, b) for a in text for b in text
        if a < b and spotsigs.jaccard(np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4")) >= threshold
    }
    df = spark.createDataFrame([(spotsigs.written(x),) for x in sets], "fingerprint string")
    assert {(r.a, r.b) for r in spotsigs.near_pairs(df, threshold=threshold).collect()} == want and want


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(result(QUERIES["op1_spotsigs"](spark, SMALL))) == sorted(by_hand(rows))


def test_twenty_thousand_bounds_are_searched_in_seconds(spark):
    import time

    import numpy as np
    import pandas as pd
    from annolytics.llm.neighbours import place_among

    bounds = sorted(set(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000).tolist()))
    keys = spark.range(200_000).selectExpr("xxhash64(id) as key").unionByName(spark.createDataFrame([(b,) for b in bounds[::500]], "key long"))
    started = time.time()
    found = keys.withColumn("code", place_among(bounds)("key")).toPandas()
    assert time.time() - started < 15
    below = np.searchsorted(bounds, found.key)
    assert (found.code // 2 == below).all() and (found.code % 2 == pd.Series(found.key).isin(bounds).astype(int)).all()
    texts = spark.createDataFrame([("a",), ("b",), ("é",), ("🙂",), ("\uffff",)], "key string").withColumn("code", place_among(["b", "é", "🙂"])("key"))
    assert [r.code for r in texts.collect()] == [0, 1, 3, 5, 4]
