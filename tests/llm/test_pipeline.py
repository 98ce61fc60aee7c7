"""The pipeline: every stage against a plain version of what it must do, on whole small tables."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from annolytics.llm import mixing, pii, resample
from annolytics.llm.merge_dropout import MODEL
from annolytics.llm.queries import WEIGHTS
from conftest import SMALL
from test_ngram_join import by_hand
from test_pii import plain_base


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SMALL).write.parquet(f"{folder}/{n}")
        out.append(spark.read.parquet(f"{folder}/{n}"))
    return out


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_quality(spark, stages):
    judged = {r.doc_id for r in resample.resample(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"), seed=5).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == judged and len(judged) < 200
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert np.mean([i in judged for i, q in labels.items() if q]) > 0.9


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {d for d, n, component, _ in by_hand(rows, 5, 80) if d == component}
    kept = [r.doc_id for r in stages[2].collect()]
    assert sorted(kept) == sorted(want) and len(kept) < len(rows)


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        assert r.n_chars == len(r.text) and not plain_base(r.text)
        if not plain_base(before[r.doc_id]) and not pii.candidates(before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_mixture(stages):
    before, after = ({}, Counter())
    for r in stages[3].collect():
        before[tuple(r)] = r.source
    for r in stages[4].collect():
        after[tuple(r)] += 1
    assert set(after) == set(before)  # nothing is left out, nothing is new
    planned = Counter(r.doc_id for r in mixing.schedule(stages[3], WEIGHTS).collect())
    assert planned == Counter({k[0]: n for k, n in after.items()})


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.lossless and library.decode(list(r.ids)) == texts[r.doc_id].removeprefix(" ") for r in rows)


def test_order_of_the_mixture_reaches_the_last_stage(stages):
    planned = sorted((r.slot, r.within, r.doc_id) for r in mixing.schedule(stages[3], WEIGHTS).collect())
    assert sorted((r.slot, r.within, r.doc_id) for r in stages[5].collect()) == planned


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "n_tokens"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).select(*key).collect())) == Counter(map(tuple, stages[-1].select(*key).collect()))


def test_empty_tables_and_odd_rows(spark, stages):
    schema = stages[0].schema
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, None, "en", "src1", 0), (3, "a@b.cd " + "good words here " * 9, "en", None, 5), (3, "a@b.cd " + "good words here " * 9, "en", None, 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} <= {r[0] for r in rows} and docs.where("not lossless").count() == 0
