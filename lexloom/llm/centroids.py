"""Centroid clustering of integer vectors (Lloyd's rounds) with partial-distance search.

A vector's squared distance to the centroids is added up over blocks of components, those of the highest variance first.
A centroid whose part alone is strictly above the best whole distance so far is abandoned; those that are left finish all
components, so the nearest centroid, ties to the smaller number, is exact. All sums are of integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import durable, table

# Fixed values of the contract.
DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Components that are added before centroids are abandoned again.
BLOCK = 8
#: Vectors that are worked on at a time.
ROWS = 4096
#: Components up to this size have squared distances and sums that 64 bits hold; greater ones are Python's integers.
SMALL = 1 << 24


def integers(vectors: pa.Array, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count (all components there, none null or not finite), and floor(scale * x) of theirs."""
    size = pc.fill_null(pc.list_value_length(vectors), -1)
    whole = np.asarray(pc.equal(size, dimensions))
    flat = vectors.filter(pa.array(whole)).flatten().cast(pa.float64())
    x = np.asarray(pc.fill_null(flat, float("nan"))).reshape(-1, dimensions)
    fine = np.isfinite(x).all(axis=1)
    whole[whole] = fine
    x = x[fine]
    if not len(x) or np.abs(x).max() < SMALL / scale:
        return whole, np.floor(x * scale).astype(np.int64)
    exact = [[(lambda n, d: scale * n // d)(*v.as_integer_ratio()) for v in row] for row in x.tolist()]
    return whole, np.array(exact, dtype=object).reshape(-1, dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of x. order: the components in turn."""
    x, c = x[:, order], centroids[:, order]
    if x.dtype != c.dtype or x.dtype == object:
        x, c = x.astype(object), c.astype(object)
    part = np.zeros((len(x), len(c)), dtype=x.dtype)
    for j in range(min(block, x.shape[1])):
        off = x[:, j, None] - c[None, :, j]
        part += off * off
    # The centroid that leads after the first block is finished first: its whole distance is what the others must beat.
    near = part.argmin(axis=1) if x.dtype != object else np.array([min(range(len(c)), key=p.__getitem__) for p in part], dtype=np.int64)
    off = x - c[near]
    best = (off * off).sum(axis=1)
    row, number = np.nonzero((part <= best[:, None]).astype(bool))
    held = part[row, number]
    for at in range(block, x.shape[1], block):
        off = x[row, at : at + block] - c[number, at : at + block]
        held = held + (off * off).sum(axis=1)
        left = (held <= best[row]).astype(bool)
        row, number, held = row[left], number[left], held[left]
    # Survivors come by row and number; a stable order by distance leaves the smaller number first.
    if x.dtype == object:
        turn = np.array(sorted(range(len(row)), key=lambda i: (row[i], held[i], number[i])), dtype=np.int64)
    else:
        turn = np.lexsort((number, held, row))
    first = turn[np.searchsorted(row[turn], np.arange(len(x)))] if len(turn) else turn
    return number[first], held[first]


def _scan(vectors: DataFrame, column: str, make: Callable, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """What `make()` yields for (batch of the vectors that count, their integers), and None at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                whole, x = integers(part.column(column))
                if len(x):
                    yield from of(part.filter(pa.array(whole)), x)
        yield from of(None, None)

    kept = vectors.select(*keep, column)
    return kept.mapInArrow(run, StructType([*kept.select(*keep).schema.fields, *StructType.fromDDL(schema).fields]))


def _cells(group: list[int], dimension: list[int], value: list[int]) -> pa.RecordBatch:
    numbers = pa.array([Decimal(v) for v in value], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(dimension, pa.int32()), numbers], ["cluster", "dimension", "total"])


def _totals(vectors: DataFrame, column: str, add: Callable) -> dict[tuple[int, int], int]:
    """Sums over all vectors by (cluster, dimension): a task sends one row a cell, whatever its vectors' number, and the
    driver gets one row a cell. add(totals, x) adds a block of vectors to a dictionary."""

    def make():
        totals: dict[tuple[int, int], int] = {}

        def of(batch, x):
            if batch is not None:
                add(totals, x)
            elif totals:
                keys = sorted(totals)
                yield _cells([k for k, _ in keys], [d for _, d in keys], [totals[k] for k in keys])

        return of

    cells = _scan(vectors, column, make, "cluster int, dimension int, total decimal(38,0)")
    summed = cells.groupBy("cluster", "dimension").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    return {(r.cluster, r.dimension): int(r.total) for r in summed.collect()}


def by_variance(vectors: DataFrame, column: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The components, those of the highest variance over all vectors first; ties by number. It decides speed, not results."""

    def add(totals, x):
        totals[-1, 0] = totals.get((-1, 0), 0) + len(x)
        for j in range(dimensions):
            totals[0, j] = totals.get((0, j), 0) + int(x[:, j].sum())
            totals[1, j] = totals.get((1, j), 0) + int((x[:, j] * x[:, j]).sum())

    got = _totals(vectors, column, add)
    n = max(got.get((-1, 0), 0), 1)
    spread = [n * got.get((1, j), 0) - got.get((0, j), 0) ** 2 for j in range(dimensions)]
    return np.array(sorted(range(dimensions), key=lambda j: (-spread[j], j)), dtype=np.int64)


def first_centroids(vectors: DataFrame, column: str, key: str, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The integers of the vectors with the smallest sha256 of `seed:key`, in its order; ties by the vector itself."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter((F.size(column) == DIMENSIONS) & fine).orderBy(digest, column).limit(clusters).select(column).collect()
    return integers(pa.array([list(r[0]) for r in rows], pa.list_(pa.float64())))[1]


def next_centroids(vectors: DataFrame, column: str, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The componentwise floor of each cluster's mean; clusters without vectors keep their centroid."""
    width = centroids.shape[1]

    def add(totals, x):
        number, _ = nearest(x, centroids, order)
        for k in np.unique(number).tolist():
            mine = x[number == k]
            totals[k, -1] = totals.get((k, -1), 0) + len(mine)
            for j, v in enumerate(mine.sum(axis=0).tolist()):
                totals[k, j] = totals.get((k, j), 0) + v

    got = _totals(vectors, column, add)
    moved = [[got[k, j] // got[k, -1] for j in range(width)] if (k, -1) in got else c for k, c in enumerate(centroids.tolist())]
    return np.array(moved, dtype=centroids.dtype if all(abs(v) <= SMALL for r in moved for v in r) else object)


def cluster(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) for each vector that counts, and the final centroids.

    Vectors with another number of components, or one that is null, not a number or infinite, are left out. With fewer
    vectors than clusters there are as many clusters as vectors, and of an empty table none. Repeated rows count each by
    themselves; repeated and null keys are ordered by their vectors, a null key counting as ''. Components of any size are
    exact; sums beyond 38 digits and distances that a long can't hold are errors. Other columns are ignored, whatever
    their names.
    """
    vectors = vectors.select(key, column)
    centroids = first_centroids(vectors, column, key, clusters)
    order = by_variance(vectors, column)
    if len(centroids):
        for _ in range(rounds):
            centroids = next_centroids(vectors, column, centroids, order)

    def make():
        def of(batch, x):
            if batch is not None and len(centroids):
                number, distance = nearest(x, centroids, order)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64())], [key, "cluster", "distance"])

        return of

    return _scan(vectors, column, make, "cluster int, distance long", (key,)), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = durable(found)
    # One row a cluster: the driver adds up 40 of them at most, and they are joined as a table of so many rows.
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    every = sum(inertia.values())
    rows = [(k, total, every, digest[k]) for k, total in sorted(inertia.items())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rounds in SQL: every distance of every vector, each round a pair of common table expressions."""
    near = """a{0} AS (SELECT vec_id, row, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT x.vec_id, x.row, x.v, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM x CROSS JOIN c{0} c) GROUP BY vec_id, row, v)"""
    mean = """c{1} AS (SELECT k, coalesce(m.v, c{0}.v) AS v FROM c{0} LEFT JOIN (
        SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY j) AS v FROM (
            SELECT k, j, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM a{0}) GROUP BY k, j) GROUP BY k) m USING (k))"""
    steps = [
        f"""x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: CAST(floor({SCALE} * e::DOUBLE) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM x ORDER BY h LIMIT {clusters}))",
    ]
    for i in range(rounds):
        steps += [near.format(i).replace(" AS (", " AS MATERIALIZED (", 1), mean.format(i, i + 1).replace(" AS (", " AS MATERIALIZED (", 1)]
    steps.append(near.format(rounds))
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (k)"""


OP13_SQL = _sql()
