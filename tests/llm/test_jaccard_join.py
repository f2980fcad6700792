import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import jaccard_join as jj
from lexloom.llm.components import components

from .edges import documents, no_documents


def brute_force(rows, threshold=0.8, k=5):
    """links and component by row number."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [links[i] for i in range(len(rows))], [min((rows[j][0] for j in groups[find(i)] if rows[j][0] is not None), default=None) for i in range(len(rows))]


def variants(n_groups, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"v{rng.integers(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("split,block", [(256, 1024), (2, 3)])
def test_agrees_with_brute_force(spark, monkeypatch, split, block):
    """With tiny limits nearly every node is split, and compared in blocks."""
    monkeypatch.setattr(jj, "SPLIT", split)
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = variants(60, 5)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999).collect()}
    links, least = brute_force(rows)
    assert got == {d: (n, c) for (d, _), n, c in zip(rows, links, least, strict=True)}


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(600)] + [(1000 + i, " ".join(base)) for i in range(300)]
    got = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
    assert {r.n_links for r in got} == {899}
    assert {r.copies for r in got if r.doc_id >= 1000} == {300}


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    links, least = brute_force(rows)
    got = jj.jaccard_join(documents(spark)).collect()
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == Counter((d, n, c) for (d, _), n, c in zip(rows, links, least, strict=True)) | Counter()
    assert jj.jaccard_join(no_documents(spark)).count() == 0


def test_runs_give_the_recall_at_any_depth():
    x = 1.0
    for _ in range(30):
        once = 1 - np.exp(-x)
        for recall in (0.5, 0.9, 0.995):
            assert 1 - (1 - once) ** jj.runs_for(recall) >= recall
        x = 1 - np.exp(-jj.SPREAD * x)


@pytest.mark.parametrize("split", [256, 8])
def test_recall_at_the_default_on_pairs_at_the_threshold(spark, monkeypatch, split):
    """Pairs of a similarity just above 0.8, each pair by itself, in a crowd that shares a long passage."""
    monkeypatch.setattr(jj, "SPLIT", split)
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for _ in range(300):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 160)]
        for edit in (0, 1):
            words = [*own]
            for at in (20, 60, 100, 140)[: 4 * edit]:
                words[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), f"{passage} " + " ".join(words)))
    links, _ = brute_force(rows[:40])
    assert set(links) == {1}
    got = jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(r.n_links for r in got) == 1
    assert sum(r.n_links for r in got) >= 0.98 * len(rows)


def test_recall_on_the_tables(spark):
    """All links of the middle tables, by brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.n_links for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, _ = brute_force(rows)
    assert sum(links) > 100
    assert sum(min(got[d], n) for (d, _), n in zip(rows, links, strict=True)) >= 0.99 * sum(links)
    assert all(got[d] <= n for (d, _), n in zip(rows, links, strict=True))


def test_mean_similarity_of_nodes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for node, shared in ((1, 0.95), (2, 0.7), (3, 0.2), (4, 0.0)):
        values = rng.integers(0, 60000, 64)
        for _ in range(400):
            sketch = np.where(rng.random(64) < np.sqrt(shared), values, rng.integers(0, 60000, 64)).astype(np.uint16)
            signs, full = (jj.bits(x[None, :])[0].as_py() for x in (sketch & 1, sketch != jj.EMPTY))
            rows.append((node, signs, full))
    got = {r.node for r in jj.unlike(spark.createDataFrame(rows, "node long, signs long, full long")).collect()}
    assert got == {3, 4}


def test_ids_may_be_texts_or_null(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six")] + [(None, "seven eight nine ten eleven twelve")] * 40
    got = Counter(map(tuple, jj.jaccard_join(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "class_id", "n_links", "copies").collect()))
    assert got == Counter({("b", "a", 2, 3): 1, ("a", "a", 2, 3): 1, (None, "a", 2, 3): 1, (None, None, 39, 40): 40})


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_edges_that_are_stars_take_no_round(spark):
    edges = spark.createDataFrame([(5, 1), (1, 7), (9, 1), (4, 3), (3, 4), (6, 6)], "u long, v long")
    sc = spark.sparkContext
    sc.setJobGroup("stars-at-once", "components")
    try:
        found = components(edges)
        jobs = len(sc.statusTracker().getJobIdsForGroup("stars-at-once"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.label for r in found.collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    assert 0 < jobs <= 6


def test_each_round_of_components_lets_go_of_the_one_before(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "u long, v long")
    assert {r.label for r in components(path).collect()} == {0}
    assert full() > before
