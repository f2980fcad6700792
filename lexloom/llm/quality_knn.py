"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of words and word shapes (letters, digits and other signs of a word in outline), weighted by
log term frequency and inverse document frequency. A truncated singular value decomposition of the labelled sample gives
the latent space; the labelled vectors are broadcast, every document's cosine with each of them is computed in exact
blocked products, and the labels of the nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, encode, hash_words, id_bucket, owners, slices, split_words, table, text_of

WORDS, SHAPES = 3072, 1024
#: Bounds of the fit: at most this many labelled rows of each label are vectors; nothing else is sampled.
PER_LABEL = 1024
RANK = 64
NEIGHBOURS = 25
#: A neighbour votes with this power of its cosine.
SHARPNESS = 4
THRESHOLD = 0.3
PUNCTUATION = ".,;:!?\"'()[]{}*$%&#|<>"


@dataclass
class Space:
    """idf by feature, projection (features x rank), and the labelled unit vectors with their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of every text, by row and feature."""
    words, counts = split_words(text)
    codes, distinct = encode(words)
    low = pc.utf8_trim(pc.utf8_lower(distinct), PUNCTUATION)
    word = (hash_words(low) % np.uint64(WORDS)).astype(np.int64)
    outline = pc.replace_substring_regex(distinct, r"\p{Lu}\p{Lu}+", "AA")
    outline = pc.replace_substring_regex(outline, r"[\p{Ll}\p{M}]+", "a")
    outline = pc.replace_substring_regex(outline, r"[0-9]+", "9")
    shape_code, shapes = encode(outline)
    shape = WORDS + (hash_words(shapes) % np.uint64(SHAPES)).astype(np.int64)[shape_code]
    row = owners(counts) << 16
    key, n = np.unique(np.concatenate([row | word[codes], row | shape[codes]]), return_counts=True)
    return key >> 16, key & 0xFFFF, n


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        row, feature, n = features(text_of(batch))
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))],
            ["quality", "feature", "n"],
        )


def _decompose(batches: Iterator[pa.RecordBatch], rank: int) -> Iterator[pa.RecordBatch]:
    """The arrays of the space, from all rows of the sample."""
    got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("quality", "feature", "n")), strict=True) if r[1]))
    if not got:
        return
    x = np.zeros((len(got), WORDS + SHAPES), dtype=np.float32)
    for i, (_, feature, n) in enumerate(got):
        x[i, feature] = np.log1p(n)
    idf = np.log((1 + len(got)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # The decomposition by way of the smaller Gram matrix, of at most 2 * per_label rows.
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = np.argsort(values)[::-1][: min(rank, len(got))]
    top = top[values[top] > 1e-9]
    basis = (x.T @ (left[:, top] / np.sqrt(values[top]))).astype(np.float32)
    vectors = x @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    quality = np.array([q for q, *_ in got], dtype=np.float32)
    yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("idf", idf), ("basis", basis), ("vectors", vectors), ("labels", quality))})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, rank: int = RANK) -> Space | None:
    """The latent space of a bounded sample: per_label rows of each label, by hash of the id. None without labelled texts.

    labels: doc_id, quality (0 or 1; rows with null are ignored; a doc_id with both counts as 0). Of a doc_id with
    several texts, the least is taken. One task decomposes the sample, so the driver holds the space alone.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    pick = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    sample = F.broadcast(pick[0].unionAll(pick[1]))  # at most 2 * per_label ids
    rows = docs.filter("text is not null").select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    counts = rows.select("quality", "text").mapInArrow(_sparse, "quality int, feature array<int>, n array<int>")
    found = counts.repartition(1).mapInArrow(lambda it: _decompose(it, rank), "idf binary, basis binary, vectors binary, labels binary").first()
    if found is None:
        return None
    idf, basis, vectors, quality = (np.frombuffer(c, dtype=np.float32) for c in found)
    return Space(idf, basis.reshape(len(idf), -1), vectors.reshape(len(quality), -1), quality)


def vectors_of(text: pa.Array, space: Space) -> np.ndarray:
    """Unit vectors of the texts; zero for texts without words."""
    row, feature, n = features(text)
    out = np.zeros((len(text), space.basis.shape[1]), dtype=np.float32)
    if len(row):
        terms = space.basis[feature] * (np.log1p(n).astype(np.float32) * space.idf[feature])[:, None]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(terms, first, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def vote(vectors: np.ndarray, space: Space, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity, pulled slightly to the mean label.

    Of vectors equally far as the last neighbour, which ones vote is the selection's choice, the same in every run."""
    prior = float(space.labels.mean())
    k = min(neighbours, len(space.labels))
    out = np.empty(len(vectors))
    for a in range(0, len(vectors), block):
        cosine = vectors[a : a + block] @ space.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1) ** SHARPNESS
        out[a : a + block] = (weight * space.labels[near]).sum(axis=1) + 0.01 * prior
        out[a : a + block] /= weight.sum(axis=1) + 0.01
    return np.clip(out, 0, 1)


def score(docs: DataFrame, space: Space | None, name: str = "score") -> DataFrame:
    """docs with the score of every row. Texts without words (null, empty) get the mean label of the sample; without any
    labels every score is 0.5. Very long texts are read whole; repeated rows agree. Other columns stay, but for one
    with the score's name, which is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(space and vars(space))

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        space = Space(**shared.value) if shared.value else None

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            text = text_of(batch)
            return [pa.array(vote(vectors_of(text, space), space) if space else np.full(len(text), 0.5))]

        return run

    return annotate(docs, make, f"{name} double", 1 << 20)


def learn(docs: DataFrame, labels: DataFrame) -> Space | None:
    """The space of the labels that aren't held out."""
    return fit(docs, labels.filter(id_bucket("doc_id", 5) != 0))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; labels of held-out ids are not learned from."""
    return score(docs.select("doc_id", "text"), learn(docs, labels)).select(
        "doc_id",
        (id_bucket("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
