import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import mixing

from .edges import documents, no_documents


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 9), st.integers(1, 3), min_size=1, max_size=4), st.data())
def test_fill_is_as_near_as_brute_force(histogram, data):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    budget = data.draw(st.integers(0, int((lengths * counts).sum())))
    take = mixing.fill(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    total = int((take * lengths).sum())
    assert total <= budget
    best = max(s for s in (int((np.array(w) * lengths).sum()) for w in itertools.product(*[range(c + 1) for c in counts.tolist()])) if s <= budget)
    assert total == best


def test_fill_large_budget_with_few_lengths():
    take = mixing.fill(np.array([1000, 1, 70_000]), np.array([10**6, 500, 3]), 600_000_123)
    assert int((take * np.array([1000, 1, 70_000])).sum()) == 600_000_123


@pytest.mark.parametrize(("budget", "best"), [(100_000, 90_000), (150_000, 150_000), (165_000, 160_000), (240_000, 240_000)])
def test_fill_with_documents_longer_than_the_window(budget, best):
    lengths = np.array([70_000, 80_000, 90_000])
    assert int((mixing.fill(lengths, np.array([1, 1, 1]), budget) * lengths).sum()) == best


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        target = {s: epochs * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in free if target[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 500, "c": 40, None: 3}, {"Z": 10}, {"é": 100, "z": 100, "a": 1, "b": 1}])
def test_targets_match_resharing_step_by_step(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = expected_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_awkward_rows(spark):
    got = mixing.mix(documents(spark)).collect()
    assert len(got) == documents(spark).count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    longest = 60_000
    assert all(abs(t - w) <= longest for t, w in by.values())
    assert mixing.mix(no_documents(spark)).count() == 0


def test_mix_meets_targets_and_repeats_itself(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    by = {}
    for _, source, _, _, target, taken, _ in one:
        by.setdefault(source, [target, 0])[1] += taken
    assert all(abs(t - w) < 0.02 * t + 50 for t, w in by.values())


def test_hot_length_takes_exactly_what_was_planned(spark):
    rows = [(i, "a b c", "x", 5) for i in range(3000)] + [(10_000 + i, "a b c d", "y", 7) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    x = [r for r in got if r.source == "x"]
    assert abs(sum(r.taken for r in x) - x[0].target) <= 3


def test_budgets_within_the_window_are_exact():
    """Few long documents, of which proportional shares would take the wrong ones."""
    rng = np.random.default_rng(7)
    for _ in range(150):
        lengths = np.sort(rng.choice(np.arange(5000, 60_000), rng.integers(1, 6), replace=False))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, min(mixing.WINDOW, int((lengths * counts).sum())) + 1))
        best = max(s for s in (int((np.array(w) * lengths).sum()) for w in itertools.product(*[range(c + 1) for c in counts.tolist()])) if s <= budget)
        assert int((mixing.fill(lengths, counts, budget) * lengths).sum()) == best
    assert int((mixing.fill(np.array([30_000, 40_000]), np.array([2, 3]), 60_000) * np.array([30_000, 40_000])).sum()) == 60_000


def test_memory_does_not_grow_with_the_number_of_lengths():
    import tracemalloc

    lengths = np.unique(np.random.default_rng(1).integers(1, 4_000_000, 4000))
    counts = np.full(len(lengths), 3)
    for ls, cs, budget in ((lengths, counts, int((lengths * counts).sum() * 0.37)), (np.array([3, 12_345_678, 17_000_000]), np.array([1, 1, 1]), 17_000_003)):
        tracemalloc.start()
        take = mixing.fill(ls, cs, budget)
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
        assert int((take * ls).sum()) == budget
