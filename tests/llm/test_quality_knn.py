import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash

from lexloom.llm import quality_knn as kn

from .edges import documents, labels, no_documents


def test_held_out_accuracy(spark, small_dir):
    docs, known = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = kn.classify(docs, known).join(known, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85


def test_blocked_vote_is_the_plain_vote():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    space = kn.Space(None, None, unit(rng.normal(size=(90, 8))).astype(np.float32), rng.integers(0, 2, 90).astype(np.float32))
    v = unit(rng.normal(size=(40, 8))).astype(np.float32)
    for i, got in enumerate(kn.vote(v, space, block=7)):
        cosine = space.vectors @ v[i]
        near = np.argsort(-cosine)[: kn.NEIGHBOURS]
        w = np.clip(cosine[near], 0, 1) ** kn.SHARPNESS
        assert abs(got - ((w * space.labels[near]).sum() + 0.01 * space.labels.mean()) / (w.sum() + 0.01)) < 1e-5


def test_features_count_words_and_shapes():
    row, feature, n = kn.features(pa.array(["Dog dog cat", ""], pa.large_string()))
    assert set(row.tolist()) == {0} and n.sum() == 6
    assert sorted(n[feature < kn.WORDS].tolist()) == [1, 2]


def plain_features(text):
    out = np.zeros(kn.WORDS + kn.SHAPES)
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        out[xxhash.xxh3_64_intdigest(w.lower().strip(kn.PUNCTUATION)) % kn.WORDS] += 1
        for pattern, sign in ((r"\p{Lu}\p{Lu}+", "AA"), (r"[\p{Ll}\p{M}]+", "a"), ("[0-9]+", "9")):
            w = regex.sub(pattern, sign, w)
        out[kn.WORDS + xxhash.xxh3_64_intdigest(w) % kn.SHAPES] += 1
    return np.log1p(out)


def test_the_whole_query_is_a_plain_version(spark, small_dir):
    """Weights, a full singular value decomposition, all cosines and the vote, one document after another."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    all_ = {r.doc_id: plain_features(r.text) for r in docs}
    own = sorted(d for d in known if d in all_ and all_[d].any())
    x = np.array([all_[d] for d in own])
    idf = np.log((1 + len(own)) / (1 + (x > 0).sum(axis=0))) + 1
    x = x * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    basis = np.linalg.svd(x, full_matrices=False)[2][: kn.RANK].T
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    vectors, y = unit(x @ basis), np.array([known[d] for d in own])
    got = {r.doc_id: r for r in kn.op5_quality_knn(spark, small_dir).collect()}
    close = 0
    for d, f in all_.items():
        cosine = vectors @ unit((f * idf) @ basis)
        near = np.argsort(-cosine)[: kn.NEIGHBOURS]
        w = np.clip(cosine[near], 0, 1) ** kn.SHARPNESS
        close += abs(got[d].score - ((w * y[near]).sum() + 0.01 * y.mean()) / (w.sum() + 0.01)) < 1e-3
    assert close >= 0.98 * len(all_)  # neighbours at nearly one distance may change places


def test_of_a_repeated_id_the_least_text_is_learned(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a a"), (2, "c c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    one, other = (kn.fit(d, labels) for d in (docs, docs.repartition(3).orderBy("text", ascending=False)))
    assert (one.vectors == other.vectors).all() and (one.idf == other.idf).all()


def test_awkward_rows(spark):
    got = kn.classify(documents(spark), labels(spark)).collect()
    assert len(got) == documents(spark).count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in kn.classify(documents(spark), labels(spark, [])).collect()} == {0.5}
    assert kn.classify(no_documents(spark), labels(spark)).count() == 0


def test_other_columns_stay(spark):
    out = kn.score(documents(spark), None, "other")
    assert out.columns == [*documents(spark).columns, "other"]
    assert kn.score(documents(spark), None).columns.count("score") == 1


def test_the_driver_holds_no_matrix_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i % 50} Word {i} end{i % 7}.") for i in range(600)], "doc_id long, text string")
    known = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    tracemalloc.start()
    try:
        space = kn.fit(docs, known)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    matrix = 600 * (kn.WORDS + kn.SHAPES) * 4
    assert len(space.labels) == 600 and peak < matrix
