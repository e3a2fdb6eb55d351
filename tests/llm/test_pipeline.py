"""The pipeline: stage by stage, what it must keep and drop."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash
from dnslens.llm import fuzzy_lines, language

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, odd):
    docs = odd
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).persist()
        assert docs.columns == odd.columns
        counts.append(docs.count())
    assert counts[0] < odd.count() and counts[1] < counts[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() >= counts[-1]


def test_stages_take_empty_tables(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DIR).count() == 0


def test_run_packs_all_words_of_the_mix(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert rows and all(r.length <= 1024 for r in rows)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_no_clean_document_is_rejected_for_its_language(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    lost = docs.join(language.identified(docs).select("doc_id"), "doc_id", "left_anti")
    assert all(not language.has_letter(r.text) for r in lost.collect())


def test_language_sends_only_texts_to_python(odd):
    """The other columns, and the rows that stay, don't pass through Python's batches."""
    kept = language.identified(odd)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    scored = {r.doc_id: r.lang_pred != language.UNKNOWN and r.score >= language.MIN_SCORE for r in language.identify(odd.filter("doc_id < 9")).collect()}
    assert {r.doc_id for r in kept.collect()} >= {i for i in (6, 7, 8) if scored[i]}


def test_the_language_model_is_fitted_outside_the_driver(odd, nothing, monkeypatch):
    """Only names and weights come to the driver, not the sample."""
    sample = language.training_sample(odd).collect()
    names, weights = language.fit([bytes(r.bits) for r in sample], [r.lang for r in sample])
    frame, came = type(odd), []
    whole = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: came.append(whole(self)) or came[-1])
    language.identified(odd)
    assert max(sum(len(x) for row in rows for x in row if isinstance(x, (bytes, bytearray))) for rows in came) <= weights.nbytes
    model = language.fitted(odd)
    assert model.names == names and np.allclose(model.weights, weights, atol=1e-6)
    assert language.fitted(nothing).names == []


def test_the_language_model_is_fitted_in_little_memory():
    draw = np.random.default_rng(1)
    bits = [draw.integers(0, 256, language.PLACES // 8, dtype=np.uint8).tobytes() for _ in range(400)]
    tracemalloc.start()
    language.fit(bits, ["a", "b"] * 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_texts_are_cut_some_at_a_time(monkeypatch):
    texts = pa.array([None, "", "one\ntwo\n \n", "one"] * 3)
    two = [{"line_no": 1, "id": int(np.uint64(xxhash.xxh64_intdigest(b"two", seed=42)).astype(np.int64))}]
    gone = pa.array([None, None, two, None] * 3)
    want = [(None, 0, 0), ("", 0, 0), ("one\n \n", 2, 1), ("one", 1, 0)] * 3
    for rows in (1, 5, 512):
        monkeypatch.setattr(fuzzy_lines, "ROWS", rows)
        assert [tuple(r.values()) for r in fuzzy_lines._without(texts, gone).to_pylist()] == want
    assert len(fuzzy_lines._without(texts[:0], gone[:0])) == 0
