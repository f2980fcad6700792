import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import audit, ordering

RANKS = {"low": lambda n: F.lit(1), "p95": lambda n: F.ceil(n * F.lit(0.95)), "high": lambda n: n}


def told(values, rank):
    ordered = sorted(values, key=lambda v: (isinstance(v, float) and math.isnan(v), v))
    return ordered[rank - 1]


CASES = {
    "double": [0.0, -0.0, 1.5, -1.5, float("inf"), float("-inf"), float("nan"), 1e-300, -1e300, 5e-324, 7.25, 7.25, 7.25, None],
    "bigint": [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 1 << 40, -(1 << 40), 12, 12, 12, None],
    "int": [-(1 << 31), (1 << 31) - 1, 0, -1, 1, 70_000, -70_000, 5, 5, None],
    "smallint": [-(1 << 15), (1 << 15) - 1, 3, 3, None],
}


@pytest.mark.parametrize("few", [0, 4, 10_000])
@pytest.mark.parametrize("kind", CASES)
def test_values_at_ranks_are_those_of_the_sorted_values(spark, monkeypatch, kind, few):
    """With `few` 0 all digits are counted, otherwise the last rows are ranked."""
    monkeypatch.setattr(ordering, "FEW", few)
    values = CASES[kind]
    groups = [("a", v) for v in values] + [(None, v) for v in values[:4]] + [("none", None)] + [("one", values[2])]
    df = spark.createDataFrame([(k, v, "x") for k, v in groups], f"k string, v {kind}, n string")
    got = {r.k: r for r in ordering.order_statistics(df, "v", ["k"], RANKS).collect()}
    assert set(got) == {"a", None, "one"}
    for k, r in got.items():
        own = [v for g, v in groups if g == k and v is not None]
        assert r.n == len(own)
        want = [told(own, rank) for rank in (1, math.ceil(0.95 * len(own)), len(own))]
        assert all(a == b or (a != a and b != b) for a, b in zip((r.low, r.p95, r.high), want, strict=True))


def test_many_groups_meet_rows_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL", 3)
    monkeypatch.setattr(ordering, "FEW", 2)
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 20, 2000), rng.normal(size=2000).round(2), strict=True)]
    got = ordering.order_statistics(spark.createDataFrame(rows, "g int, v double"), "v", ["g"], RANKS).collect()
    assert len(got) == 20
    for r in got:
        own = sorted(v for g, v in rows if g == r.g)
        assert (r.low, r.p95, r.high) == (own[0], own[math.ceil(0.95 * len(own)) - 1], own[-1])


def test_statistics_of_nothing_and_of_groups(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert tuple(audit.size_statistics(empty, "v").first()) == (None,) * 4 and tuple(audit.latency_statistics(empty, "v").first()) == (None,) * 5
    assert audit.latency_statistics(empty, "v", "g").count() == 0
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), (None, 2.0), ("b", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in audit.size_statistics(df, "v", "g").collect()}
    assert got == {"a": (1.0, 4.0, 2.5, 2.5), None: (2.0, 2.0, 2.0, 2.0), "b": (None,) * 4}
    assert tuple(audit.size_statistics(df, "v").first()) == (1.0, 4.0, 2.0, 7 / 3)
    with pytest.raises(ValueError, match="no order statistics"):
        ordering.order_statistics(df, "g", [], RANKS)


def test_running_numbers_and_sums(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(v) if v % 7 else None, float(v) / 2) for i, v in enumerate(rng.integers(-50, 50, 3000))]
    df = spark.createDataFrame(rows, "id int, v int, w double")
    got = ordering.running(df, [F.col("v").desc_nulls_last(), "id"], {"upto": "v", "half": "w"}, partitions=7).orderBy("ordinal").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.id for r in got] == [r[0] for r in want] and [r.ordinal for r in got] == list(range(3000))
    assert [r.upto for r in got] == np.cumsum([r[1] or 0 for r in want]).tolist()
    assert np.allclose([r.half for r in got], np.cumsum([r[2] for r in want]))
    assert ordering.running(df.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError, match="ordinal"):
        ordering.running(df.withColumnRenamed("w", "Ordinal"), ["id"])


def test_no_window_over_the_whole_table(spark):
    """Neither shares nor numbers bring all rows into one task."""
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    for out in (audit.cumulative_share(df, "k"), ordering.running(df, ["k"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
