import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import centroids as ce

ROWS = st.integers(0, 2**32 - 1).map(np.random.default_rng)


@settings(max_examples=60, deadline=None)
@given(ROWS, st.integers(1, 40), st.integers(1, 12), st.sampled_from([1, 3, 200]), st.booleans())
def test_partial_distances_find_the_nearest(rng, n, k, size, exact):
    """Small values make ties; `exact` takes the way of numbers that 64 bits don't hold."""
    x, c = rng.integers(-size, size + 1, (n, 64)), rng.integers(-size, size + 1, (k, 64))
    whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    if exact:
        x, c = x.astype(object), c.astype(object)
    number, distance = ce.nearest(x, c, rng.permutation(64), 5)
    assert number.tolist() == whole.argmin(axis=1).tolist() and distance.tolist() == whole.min(axis=1).tolist()


def test_integers_are_floors_of_whole_vectors_only():
    ok = [0.5, -0.001, *[1.0] * 62]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("-inf"), *[1.0] * 63]]
    whole, x = ce.integers(pa.array([ok, *bad, ok], pa.list_(pa.float32())))
    assert whole.tolist() == [True, *[False] * 7, True] and x.tolist() == [[128, -1, *[256] * 62]] * 2
    great = [2.0**70, -0.75, *[0.0] * 62]
    assert ce.integers(pa.array([great], pa.list_(pa.float64())))[1].tolist() == [[2**78, -192, *[0] * 62]]


def plain(rows, rounds=ce.ROUNDS, clusters=ce.CLUSTERS):
    """Every distance in every round, in Python's integers."""
    kept = [(i, [int(np.floor(ce.SCALE * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:clusters]]

    def assign():
        c = np.array(centroids, dtype=object)
        far = [((np.array(v, dtype=object) - c) ** 2).sum(axis=1) for _, v in kept]
        return [(int(f.argmin()), int(f.min())) for f in far]

    for _ in range(rounds):
        own = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, own, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, *a) for (i, _), a in zip(kept, assign(), strict=True)], centroids


def test_the_whole_query_is_a_plain_version_and_its_sql(spark, small_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    want, centroids = plain(rows)
    got = ce.op13_centroids(spark, small_dir)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == sorted(want)
    digest = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centroids)}
    assert all(r.centroid_sha256 == digest[r.cluster] and r.inertia == sum(d for _, _, d in want) for r in got.collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(ce.OP13_SQL).fetchall())


SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=64).tolist()) for i in range(70)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [None] * 64), (104, [float("inf")] * 64), (105, [float("nan")] * 64)]
    rows = [*good, good[0], good[0], (None, good[3][1]), *bad, *((i, good[5][1]) for i in range(200, 220))]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got, centroids = ce.cluster(frame)
    want, others = plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and centroids.tolist() == others
    got, centroids = ce.cluster(spark.createDataFrame([(*r, "x", "y") for r in good[:3]], SCHEMA))
    assert {(r.vec_id, r.distance) for r in got.collect()} == {(0, 0), (1, 0), (2, 0)} and len(centroids) == 3
    got, centroids = ce.cluster(spark.createDataFrame([(*r, "x", "y") for r in bad], SCHEMA))
    assert got.count() == 0 and len(centroids) == 0
    assert ce.cluster(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_great_components_are_exact(spark):
    rows = [(1, [1e6] * 64), (2, [-1e6] * 64), (3, [1e6 - 1] * 64)]
    got, _ = ce.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=2)
    want = {r[0]: r[2] for r in plain(rows, clusters=2)[0]}
    assert want[1] == 64 * 128**2 and {r.vec_id: r.distance for r in got.collect()} == want
