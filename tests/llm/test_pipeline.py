"""The pipeline's stages against plain versions on a small fixture."""

import re

import pytest

import corpus_pipeline as cp

from .edges import documents, no_documents
from .test_jaccard_join import brute_force


@pytest.fixture(scope="module")
def staged(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema) if docs.columns == cp.COLUMNS else docs
        docs = stage(spark, docs, small_dir).cache()
        out.append(docs.collect())
    return out


def test_stages_are_five_and_keep_the_columns(staged):
    assert [n for n, _ in cp.STAGES] == ["quality_knn", "jaccard_join", "decontaminate", "secret_crf", "mixing"]
    assert all(list(rows[0].asDict()) == cp.COLUMNS for rows in staged[:-1])
    assert list(staged[-1][0].asDict()) == [*cp.COLUMNS, "repeats"]


def test_quality_drops_what_the_classifier_rejects(spark, small_dir, staged):
    from lexloom.llm.quality_knn import op5_quality_knn

    good = {r.doc_id for r in op5_quality_knn(spark, small_dir).collect() if r.predicted == 1}
    assert {r.doc_id for r in staged[1]} == good


def test_one_document_of_each_group_stays(staged):
    rows = [(r.doc_id, r.text) for r in staged[1]]
    _, least = brute_force(rows)
    assert {r.doc_id for r in staged[2]} == set(least)


def test_no_benchmark_item_stays(spark, small_dir, staged):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    for r in staged[3]:
        text = " " + " ".join(r.text.lower().split()) + " "
        assert not any(" " + " ".join(i) + " " in text for i in items)
    gone = {r.doc_id for r in staged[2]} - {r.doc_id for r in staged[3]}
    assert len(gone) < len(staged[2]) / 4


def test_secrets_are_masked_and_nothing_else(staged):
    before = {r.doc_id: r.text for r in staged[3]}
    assert len(staged[4]) == len(staged[3])
    for r in staged[4]:
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text)
        assert r.n_chars == len(r.text)
        assert "[SECRET]" in r.text or r.text == before[r.doc_id]


def test_mix_repeats(staged):
    assert {r.repeats for r in staged[5]} <= {1, 2}
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) * getattr(r, "repeats", 1) for r in rows)
    assert abs(words(staged[5]) - 1.5 * words(staged[4])) < 0.05 * words(staged[4])


def test_run_is_the_stages_in_turn(spark, small_dir, staged):
    assert sorted(r.doc_id for r in cp.run(spark, small_dir).collect()) == sorted(r.doc_id for r in staged[5])


def test_awkward_rows(spark, small_dir):
    docs = documents(spark)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, small_dir)
        assert out.columns[:5] == cp.COLUMNS
        out.collect()
        assert stage(spark, no_documents(spark), small_dir).count() == 0
    kept = cp.near_duplicate_stage(spark, docs, small_dir).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_copies_without_ids_go_and_repeated_rows_are_taken_as_often_as_the_mix_says(spark, small_dir):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, text + " x", "en", "a", 1), (5, text, "en", "a", 1), (None, "another text", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0, len(r.text)) for r in cp.near_duplicate_stage(spark, docs, small_dir).collect()) == [(0, 12), (5, len(text))]
    mixed = cp.mixing_stage(spark, docs, small_dir).collect()
    assert sum(r.repeats * len(r.text.split()) for r in mixed) in (364, 365)  # 1.5 times 243 words
