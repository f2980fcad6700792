import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import periodic_runs as pr

from .edges import documents, no_documents


def plain_runs(w, least=12):
    """Every period, every stretch of words that agree with the word one period on."""
    w, out = np.asarray(w, dtype=np.int64), []
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist(), strict=True):
            if e - s >= max(least, 2 * q) and not any((w[s : e - p] == w[s + p : e]).all() for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


SEQUENCES = st.lists(st.integers(0, 2), max_size=70) | st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)).map(lambda x: x[0] * x[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(SEQUENCES, max_size=5), st.sampled_from([2, 5, 12, 13]))
def test_runs_are_those_of_every_period(sequences, least):
    words = [[f"w{c}" for c in s] for s in sequences]
    runs, kept = pr.find(pa.array(words, pa.list_(pa.string())), least)
    got = [[(r["start"], r["length"], r["period"]) for r in rs] for rs in runs.to_pylist()]
    assert got == [plain_runs(s, least) for s in sequences]
    assert kept.to_pylist() == [collapsed(w, r) for w, r in zip(words, got, strict=True)]
    for s, r in zip(sequences, got, strict=True):  # the automaton alone, without what goes before it
        assert not s or pr.runs_of(np.array(s), least) == r


def test_segments_hold_all_runs_and_leave_the_rest_out():
    rng = np.random.default_rng(2)
    loose = rng.permutation(5000)
    far = np.concatenate([loose[:20], loose[100:900], loose[:20]])  # a passage that occurs twice, far apart
    assert len(pr.segments(far, np.array([len(far)]))[0]) == 0
    near = np.concatenate([loose[:50], np.tile(loose[60:67], 4), loose[50:60]])
    at, n = pr.segments(near, np.array([len(near)]))
    assert len(at) == 1 and at[0] <= 50 and at[0] + n[0] >= 78


def test_an_ordered_set_knows_neighbours(monkeypatch):
    monkeypatch.setattr(pr, "BLOCK", 3)
    order = list(range(1, 200))
    random.Random(1).shuffle(order)
    ends, held = pr.Ends(0), [0]
    for x in order:
        below, above = [y for y in held if y < x], [y for y in held if y > x]
        assert ends.add(x) == (max(below, default=None), min(above, default=None))
        held.append(x)
    assert list(ends) == list(range(200)) and ends.size == 200


def test_long_repeats_take_little_time():
    n = 60_000
    assert pr.runs_of(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    assert pr.runs_of(np.arange(n) % 700) == [(0, n, 700)]


def test_the_whole_query_is_a_plain_version(spark, small_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = pr.op12_periodic_runs(spark, small_dir).collect()
    assert len(got) == len(texts) and any(r.n_runs for r in got)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 4000:  # the plain version takes the square
            continue
        code = {w: i for i, w in enumerate(words)}
        runs = plain_runs([code[w] for w in words])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_awkward_rows(spark):
    docs = documents(spark).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).withColumn("words", F.split("text", " "))
    got = pr.periodic_runs(docs).collect()
    assert len(got) == docs.count() and got[0].collapsed is not None
    assert {(len(r.runs), r.collapsed) for r in got if r.doc_id == 6} == {(0, "the same few words")}
    assert {(len(r.runs), r.collapsed) for r in got if r.doc_id == 1} == {(0, "")}
    rows = spark.createDataFrame([([None, "a"] * 8,), ([],), (None,), (["b"] * 12,), (["b"] * 11,)], "words array<string>")
    got = [(r.collapsed, [tuple(x) for x in r.runs]) for r in pr.periodic_runs(rows).collect()]
    assert got == [(" a", [(0, 16, 2)]), ("", []), ("", []), ("b", [(0, 12, 1)]), (" ".join("b" * 11), [])]
    empty = pr.periodic_runs(no_documents(spark).withColumn("words", F.split("text", " ")))
    assert empty.count() == 0
