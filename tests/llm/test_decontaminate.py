import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import decontaminate as dc

from .edges import documents, no_documents


def test_finds_items_wherever_they_stand(spark):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(int(n))) + ". " + " ".join(word() for _ in range(8)) + ".") for i, n in enumerate(rng.integers(6, 90, 40))]
    rows, want = [], set()
    for d in range(160):
        own = [word() for _ in range(int(rng.integers(0, 300)))]
        if d % 2:
            item = d % 40
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = items[item][1].split()
            want.add((d, item))
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dc.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == want
    assert all(0.6 <= x.score <= 1 for r in got for x in r.leaks)


def test_several_indexes_find_the_same(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    found = lambda: sorted((r.doc_id, sorted((x.item_id, round(x.score, 9)) for x in r.leaks)) for r in dc.leaks(docs, items).collect())
    one = found()
    parts = dc.indexes(items, 300)
    assert len(parts) > 1
    monkeypatch.setattr(dc, "indexes", lambda items: parts)
    assert found() == one


def plain_scores(index, query):
    score = np.zeros(len(index.item))
    for t in query:
        a, b = index.at[t], index.at[t + 1]
        score[index.piece[a:b]] += index.share[a:b]
    return score


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 64]), st.floats(0.05, 0.9))
def test_block_max_wand_retrieves_all_above(seed, block, threshold):
    rng = np.random.default_rng(seed)
    n, m = 12, 40
    lists = [np.sort(rng.choice(m, int(rng.integers(1, 20)), replace=False)) for _ in range(n)]
    at = np.cumsum([0, *map(len, lists)])
    index = dc.Index(np.arange(n), at, np.concatenate(lists), rng.uniform(0.01, 0.4, at[-1]), None, None, np.arange(m), {})
    query = np.flatnonzero(rng.random(n) < 0.6).tolist()
    old, dc.BLOCK = dc.BLOCK, block
    try:
        got = dict(dc.block_max_wand(query, index, threshold))
    finally:
        dc.BLOCK = old
    score = plain_scores(index, query)
    assert set(got) == set(np.flatnonzero(score >= threshold - 1e-9).tolist())
    assert all(abs(got[p] - score[p]) < 1e-9 for p in got)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_leave_nothing_out(spark, seed):
    """Every passage of every row, searched one by one, finds what the bounded search finds."""
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 301)
    draw = lambda n: [f"w{x}" for x in rng.choice(300, n, p=weights / weights.sum())]
    items = [(i, " ".join(draw(int(rng.integers(3, 70))))) for i in range(30)]
    (index,) = dc.indexes(spark.createDataFrame(items, "item_id long, text string"))
    rows = [draw(int(rng.integers(0, 200))) for _ in range(40)]
    for r in rows[::3]:
        at = int(rng.integers(0, len(r) + 1))
        r[at:at] = items[int(rng.integers(0, 30))][1].split()[: int(rng.integers(1, 60))]
    import pyarrow as pa

    h, counts, _ = dc.term_hashes(pa.array([" ".join(r) for r in rows], pa.large_string()))
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    code = np.where(index.terms[at] == h, at, -1)
    got = dc.passages_above(code, counts, index, dc.THRESHOLD)
    start = 0
    for i, n in enumerate(counts.tolist()):
        best = np.zeros(len(index.item))
        for a in range(0, max(n, 1), dc.STEP):
            best = np.maximum(best, plain_scores(index, [t for t in np.unique(code[start + a : start + min(n, a + 2 * dc.STEP)]) if t >= 0]))
        start += n
        assert set(got.get(i, {})) == set(np.flatnonzero(best >= dc.THRESHOLD - 1e-9).tolist())


def test_overlaps_by_hand():
    words = lambda t: np.array([hash(w) & 0xFFFFFFFF for w in re.findall(r"\w+", t)], dtype=np.uint64)
    item = (words("what is the name of the river it is the seine"), 7)
    assert dc.overlaps(item, words("so what is the name of the river and then it is the seine")) == (1.0, 1.0)
    assert dc.overlaps(item, words("what is the name of the river")) == (1.0, 0.0)


def test_every_text_of_an_item_is_verified(spark):
    texts = [f"what is the colour of thing number{i} in the old house by the sea. it is shade{i} of the deep tone{i} there" for i in range(4)]
    items = spark.createDataFrame([(1, t) for t in texts], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so they say {t} and nothing more") for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in dc.leaks(docs, items).collect()} == {i: [1] for i in range(4)}
    assert {(r.question, r.answer) for d in dc.leaks(docs, items).collect() for r in d.leaks} == {(1.0, 1.0)}


def test_hits_are_those_of_plain_bm25_in_sql(spark, small_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    want = con.sql(dc.OP9_SQL)
    got = [tuple(r) for r in dc.op9_decontaminate(spark, small_dir).select(want.columns).collect()]
    assert want.columns[:2] == ["doc_id", "item_id"] and len(got) > 0
    assert sorted(got) == sorted((*r[:2], *map(float, r[2:])) for r in want.fetchall())


def test_ids_may_be_texts(spark):
    items = spark.createDataFrame([("a-1", "what is the colour of this thing. it is shade seven of all"), ("a-2", "The, same few words")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "they say what is the colour of this thing. it is shade seven of all", "old"), ("y", "the same few words", "old")], "doc_id string, text string, Leaks string")
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in dc.leaks(docs, items).collect()} == {"x": ["a-1"], "y": ["a-2"]}


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "the same few words"), (2, None), (None, "x y z"), (3, ""), (1, "the same few words")], "item_id long, text string")
    got = dc.leaks(documents(spark), items)
    assert got.columns == [*documents(spark).columns, "leaks"]
    assert sorted(r.doc_id for r in got.collect() if r.leaks) == [6, 6, 7]
    assert not any(r.leaks for r in dc.leaks(documents(spark), items.limit(0)).collect())
    assert dc.leaks(no_documents(spark), items).count() == 0


def test_columns_of_the_callers_stay(spark):
    docs = documents(spark).withColumn("_leaks0", F.lit("mine")).withColumn("Leaks_0", F.lit("too"))
    items = spark.createDataFrame([(1, "some benchmark text of a few words that stands nowhere")], "item_id long, text string")
    got = dc.leaks(docs, items)
    assert got.columns == [*docs.columns, "leaks"] and {(r["_leaks0"], r["Leaks_0"]) for r in got.collect()} == {("mine", "too")}
