"""Helpers shared by the corpus operators: shared storage, training splits and Arrow word streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.storage import durable, let_go, shared_path  # noqa: F401 - the operators take them from here

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % k


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about max_bytes of text; a longer text stands alone and whole."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = (np.cumsum(size) - size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as large strings, null as empty. Copied: some Arrow kernels misread the offsets of a slice."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return pa.concat_arrays([text, text.slice(0, 0)])


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    counts = np.diff(np.asarray(lists.offsets))
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        ends = np.cumsum(np.concatenate([[0], full]))
        starts = np.concatenate([[0], np.cumsum(counts)])
        counts = np.diff(ends[starts])
        flat = flat.filter(pa.array(full))
    return flat, counts.astype(np.int64)


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's code, and the distinct words by code."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every task and run."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def owners(counts: np.ndarray) -> np.ndarray:
    """For each element of a flattened list column, the row it belongs to."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the flattened values by row; 0 for rows without any."""
    ends = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]


def windows(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie within one row, and how many each row has."""
    n = np.maximum(counts - k + 1, 0)
    if len(codes) < k:
        return np.zeros(0, dtype=np.uint64), n
    h = codes[: len(codes) - k + 1].astype(np.uint64)
    for i in range(1, k):
        h = mix(h) * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - k + 1 + i].astype(np.uint64)
    row = owners(counts)
    inside = row[: len(row) - k + 1] == row[k - 1 :]
    return mix(h[inside]), n


def annotate(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], added: str, max_bytes: int) -> DataFrame:
    """docs with columns computed from each row; a column of docs with an added name is replaced.

    make is called once a task and returns what maps a batch to the added columns (`added`: their names and types).
    """
    fields = StructType.fromDDL(added).fields
    names = [f.name for f in fields]
    low = {n.lower() for n in names}
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in low or c == "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in slices(batches, "text", max_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns, *of(batch)], [*batch.schema.names, *names])

    schema = StructType([*kept.schema.fields, *fields])
    return kept.mapInArrow(run, schema)
