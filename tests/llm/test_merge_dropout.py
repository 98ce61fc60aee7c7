"""Merge-dropout against the published library at rate 0, and exact round trips at other rates."""

import pytest
import sentencepiece
from annolytics.llm import merge_dropout
from annolytics.llm.merge_dropout import MODEL, MergeDropout
from annolytics.llm.queries import QUERIES
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

ODD = ["", " ", "  a  b ", "<s> </s> <0x41>", "é́ﬁ①\U0001f600", "a\n\tb\r\n", "a" * 5000, "no spaces" * 300, "\x00x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_without_dropout_it_is_the_plain_segmentation(spark, library):
    plain = MergeDropout(rate=0)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]
    for text in texts + [t for t in ODD if "\x00" not in t]:
        assert plain.encode(text) == library.encode(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    coder = _coder()
    for variant in range(2):
        assert coder.decode(coder.encode(text, variant)) == text


def _coder(kept=[]):  # noqa: B006
    if not kept:
        kept.append(MergeDropout(rate=0.3, seed=5))
    return kept[0]


@pytest.mark.parametrize("text", [*ODD, "x▁y", "▁", "▁▁ ▁"])
def test_round_trip_of_odd_texts(text):
    assert _coder().decode(_coder().encode(text)) == text


def test_seeds_and_variants_vary_and_repeat():
    text = "segmentation of internationalisation varies considerably " * 3
    same = [MergeDropout(rate=0.2, seed=s).encode(text) for s in (1, 1, 2)]
    assert same[0] == same[1] != same[2]
    one = MergeDropout(rate=0.2, seed=1)
    assert one.encode(text, 0) != one.encode(text, 1)


def test_share_of_skipped_merges_follows_the_rate(spark):
    text = " ".join(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(9).collect())
    sizes = [len(MergeDropout(rate=r).encode(text)) for r in (0.0, 0.1, 0.5, 1.0)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[1] < sizes[2] < sizes[3]
    assert sizes[3] >= len(text) + 1  # every character alone, or as its bytes


@given(st.text("aeinst▁", min_size=1, max_size=40), st.integers(0, 99))
@settings(max_examples=200, deadline=None)
def test_both_agendas_agree(word, key):
    assert _coder().spans_of_short(word, key) == _coder().spans_of_long(word, key)


def test_batch_limits_do_not_change_ids(monkeypatch):
    texts = [" ".join(f"word{i % 50}  x" for i in range(300)), "", "a b▁ c " * 40, "unbroken" * 30, *ODD]
    variants = list(range(len(texts)))
    coder = MergeDropout(rate=0.2)
    want = coder.encode_all(texts, variants)
    assert want[2].all() and [want[0][a:b].tolist() for a, b in zip(want[1], want[1][1:])] == [coder.encode(t, v) for t, v in zip(texts, variants)]
    for chars, units in ((1, 3), (17, 16_384), (64, 7), (1000, 100)):
        monkeypatch.setattr(merge_dropout, "BATCH_CHARS", chars)
        monkeypatch.setattr(merge_dropout, "BATCH_UNITS", units)
        assert [x.tolist() for x in coder.encode_all(texts, variants)] == [x.tolist() for x in want]


def test_a_wrong_decoding_is_seen():
    coder = MergeDropout(rate=0)
    ids, ends, whole = coder.encode_all(["one two", "three"], [0, 0])
    assert whole.all()
    coder.bytes = coder.bytes.copy()
    coder.bytes[coder.begins[ids[-1]]] ^= 1
    assert coder.encode_all(["one two", "three"], [0, 0])[2].tolist() == [True, False]


def test_every_occurrence_is_cut_anew():
    """Within a document and between documents, as often as the draws of the plain agenda say."""
    coder, word, n = MergeDropout(rate=0.2, seed=1), "▁internationalisation", 400
    cuts = []
    for document in range(3):
        want = [coder.merged(word, int(k)) for k in coder.keys(n, document)]
        assert coder.encode(" ".join([word[1:]] * n), document) == sum(want, [])
        cuts += [tuple(x) for x in want]
    assert len(set(cuts)) > 20 and cuts[:n] != cuts[n : 2 * n] != cuts[2 * n :]


def test_trees_give_what_the_plain_agenda_gives(spark):
    coder = MergeDropout(rate=0.3, seed=4)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(40).collect()]
    for document, text in enumerate([*texts, *(t for t in ODD if t), *texts]):
        units = coder.units(text)
        keys = coder.keys(len(units), document).tolist()
        assert coder.encode(text, document) == sum((coder.merged(u, k) for u, k in zip(units, keys)), [])


def test_frames(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "a b"), (1, "a b"), (4, "long text " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as ids", "8 as _text", "9 as variant")
    got = merge_dropout.encode(df)
    assert got.count() == 6 and all(r.lossless for r in got.collect())
    assert {(r.doc_id, len(r.ids)) for r in got.collect() if r.doc_id in (2, 3)} == {(2, 0), (3, 0)}
    back = merge_dropout.decode(got.select("doc_id", "ids"))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert merge_dropout.encode(df.limit(0)).collect() == []
    assert merge_dropout.encode(df, keep=["text"]).columns == ["doc_id", "text", "variant", "n_tokens", "ids", "lossless"]


def test_query_round_trip(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op10_merge_dropout"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.lossless and r.n_tokens == len(r.ids) and library.decode(list(r.ids)) == docs[r.doc_id].removeprefix(" ")
