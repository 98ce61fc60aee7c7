"""The divergence audit against a plain version in whole numbers of Python, and its cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from annolytics.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        peers = [s for at, s in groups if at == lang]

        def weights(table):
            total = sum(table[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (table[t] + 5) // total for t in kept}

        own, whole = weights(counts[lang, source]), weights(sum((counts[lang, s] for s in peers), Counter()))
        pairs = [(s, sum(abs(own[t] - p) for t, p in weights(counts[lang, s]).items())) for s in peers if s != source]
        terms = [(t, own[t] - whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def result(df, **options):
    rows = divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(map(tuple, rows))


def made(seed, n):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Ünder", "naïve", "日本", "🙂", "It's"]
    hot = lambda: "big" if draw.random() < 0.4 else f"s{draw.randrange(6)}"
    return [
        (" ".join(draw.choices(words, k=draw.randrange(0, 60))), draw.choice(["en", "en", "de", None, ""]), draw.choice([hot(), hot(), None]))
        for _ in range(n)
    ]


def test_against_the_plain_version(spark):
    rows = made(3, 400)
    assert result(frame(spark, rows).repartition(5), least_docs=7, top=9) == plain(rows, 7, 9)


def test_terms_are_runs_of_letters_with_ascii_lower_case():
    text = "Don't ÀÉ x1y z\t\x7f[_]🙂 A"
    assert [t.decode() for t in divergence.terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


def test_null_empty_and_termless_groups(spark):
    rows = [(None, None, None), ("", "", "a"), ("12 34", "xx", "a"), ("12", "xx", "b"), ("word", "yy", "only")] * 3
    found = result(frame(spark, rows), least_docs=3)
    assert found == plain(rows, 3, 50)
    assert [r for r in found if r[0] == "xx"] == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_empty_table_and_clashing_columns(spark):
    assert result(frame(spark, [])) == []
    rows = made(5, 60)
    extra = [(*r, 1, 2, 3, 4) for r in rows]
    df = spark.createDataFrame(extra, "text string, lang string, source string, term int, docs int, piece int, counts int")
    assert result(df, least_docs=2) == plain(rows, 2, 50)


def test_spilled_stripes_merge_to_the_same():
    rows = made(7, 200)
    batch = pa.RecordBatch.from_pydict({
        "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows], "text": [r[0] for r in rows],
    })
    whole = pa.Table.from_batches(divergence.fold_documents(iter([batch])))
    spilled = pa.Table.from_batches(divergence.fold_documents(iter([batch]), held=50))
    assert spilled.num_rows > 3 * whole.num_rows

    def merged(table):
        ordered = table.sort_by([("lang", "ascending"), ("term", "ascending")])
        out = pa.Table.from_batches(divergence.merge_stripes(iter(ordered.to_batches(max_chunksize=37)), 2)).to_pylist()
        return {(r["lang"], r["term"]): (r["docs"], dict(zip(r["sources"], r["counts"]))) for r in out}

    assert merged(spilled) == merged(whole)


def test_parts_of_a_language_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PART_TERMS", 20)
    monkeypatch.setattr(divergence.Emitter, "ENTRIES", 16)
    rows = made(9, 300)
    assert result(frame(spark, rows), least_docs=4) == plain(rows, 4, 50)


@pytest.mark.parametrize("count, total", [(0, 1), (3, 8), (10**12, 10**13), (4 * 10**15, 4 * 10**15 + 5)])
def test_weights_are_exact_for_large_counts(count, total):
    got = divergence.weigh(np.array([count], np.int64), np.array(total + 5, np.int64))
    assert int(got[0]) == 1 + 10**9 * (count + 5) // (total + 5)


def test_one_very_long_document(spark):
    rows = [("word " * 400_000 + "end", "en", "a"), ("word", "en", "b")]
    assert result(frame(spark, rows), least_docs=1) == plain(rows, 1, 50)
