"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (one to three characters of lower-cased words, padded with
a blank) by rank. A document's own ranking is compared with each profile: the out-of-place distance adds, over the
document's n-grams, how far each is from its rank in the profile, or the profile's length where it is missing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_bucket, slices, table, text_of

#: N-grams in a profile, of a language or a document.
PROFILE = 300
UNKNOWN = "und"
BLANK = 0x20


def _letters() -> np.ndarray:
    """For each 16-bit code point, its lower-case letter or mark, or a blank for anything else. Others count as U+FFFF."""
    to = np.full(0x10000, BLANK, dtype=np.uint16)
    for c in range(0x10000):
        s = chr(c)
        if unicodedata.category(s)[0] in "LM":
            low = s.lower()
            to[c] = ord(low) if len(low) == 1 else c
    return to


_TABLE: list[np.ndarray] = []


def with_letters(text: pa.Array) -> np.ndarray:
    """Whether each text has a letter; marks alone are none."""
    return np.asarray(pc.match_substring_regex(text, r"\p{L}"))


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of every n-gram of every text, by row and n-gram. An n-gram packs three 16-bit characters."""
    if not _TABLE:
        _TABLE.append(_letters())
    parts = text.to_pylist()
    chars = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(p) + 1 for p in parts])
    row = np.repeat(np.arange(len(parts), dtype=np.uint64), np.diff(ends, prepend=0))
    astral = chars > 0xFFFF
    low = _TABLE[0][np.where(astral, 0, chars)]
    if astral.any():
        known, at = np.unique(chars[astral], return_inverse=True)
        letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in known.tolist()])
        low[astral] = np.where(letter[at], np.uint16(0xFFFF), np.uint16(BLANK))
    blank = low == BLANK
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))  # runs of blanks become one
    # A text always ends in a blank of its own, so no word runs into the next text.
    low, row, blank = low[keep].astype(np.uint64), row[keep], blank[keep]
    if not len(low):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = np.concatenate([[np.uint64(BLANK)], low])
    blank = np.concatenate([[True], blank])
    row = np.concatenate([row[:1], row])
    one = low[~blank] | (row[~blank] << np.uint64(48))
    pair = ~(blank[:-1] & blank[1:])
    two = ((low[:-1] << np.uint64(16)) | low[1:] | (row[1:] << np.uint64(48)))[pair]
    mid = ~blank[1:-1]
    three = ((low[:-2] << np.uint64(32)) | (low[1:-1] << np.uint64(16)) | low[2:] | (row[1:-1] << np.uint64(48)))[mid]
    key = np.concatenate([one, two, three])
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), (key & np.uint64((1 << 48) - 1)).astype(np.int64), n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        for at in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(at, 1 << 15)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language, merged over many texts before they are sent on."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        gram = np.concatenate([g for g, _ in held[lang]])
        key, inverse = np.unique(gram, return_inverse=True)
        return key, np.bincount(inverse, np.concatenate([c for _, c in held[lang]])).astype(np.int64)

    for batch in _blocks(batches):
        row, gram, n = grams(text_of(batch))
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        for lang in set(langs):
            mine = (langs == lang)[row]
            held.setdefault(lang, []).append((gram[mine], n[mine]))
            if len(held[lang]) >= 16:
                held[lang] = [merged(lang)]
    for lang in held:
        key, n = merged(lang)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, dict[int, int]]:
    """Rank by n-gram for each language. docs: text, lang; rows without either are ignored.

    The driver and the executors hold `size` ranks for each language tag; tags come from a closed standard list of a
    few thousand, so this is some tens of MB at the very most, whatever the corpus size.
    """
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        docs.filter("text is not null and lang is not null")
        .select("lang", "text")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= size)
    )
    out: dict[str, dict[int, int]] = {}
    for r in top.select("lang", "gram", "rank").collect():
        out.setdefault(r.lang, {})[r.gram] = r["rank"] - 1
    return dict(sorted(out.items()))


def distances(text: pa.Array, tables: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of every text from every profile, and how many n-grams each text ranks (0 without letters)."""
    row, gram, n = grams(text)
    order = np.argsort((row << 32) | ((1 << 32) - 1 - n), kind="stable")  # ties stay in n-gram order
    row, gram = row[order], gram[order]
    kinds = np.bincount(row, minlength=len(text))
    place = np.arange(len(row)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    near = place < size
    row, gram, place = row[near], gram[near], place[near]
    far = np.zeros((len(text), len(tables)))
    for j, (keys, ranks) in enumerate(tables):
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        off = np.where(keys[at] == gram, np.abs(ranks[at] - place), size)
        far[:, j] = np.bincount(row, off, minlength=len(text))
    return far, np.where(with_letters(text), np.minimum(kinds, size), 0)


def identify(docs: DataFrame, profiles: dict[str, dict[int, int]], size: int = PROFILE) -> DataFrame:
    """docs' doc_id with lang_pred and score, for every row.

    The score is 1 - distance / largest possible distance, scaled by the lead over the second language, so it lies in
    [0, 1]. Null, empty and letterless texts are `und` with score 0; so is everything if no profile was learned. Very
    long texts are ranked whole. Equal distances go to the first language by code point. Repeated rows agree; other
    columns are ignored, whatever their names; no rows give none.
    """
    names = list(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for name in names:
            keys = np.array(sorted(profiles[name]), dtype=np.int64)
            tables.append((keys, np.array([profiles[name][k] for k in keys.tolist()], dtype=np.int64)))
        for batch in _blocks(batches):
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if tables:
                far, known = distances(text_of(batch), tables, size)
                best = far.argmin(axis=1)
                first = far[np.arange(len(best)), best]
                far[np.arange(len(best)), best] = np.inf
                second = far.min(axis=1) if len(tables) > 1 else np.full(len(best), np.inf)
                lead = np.where(np.isfinite(second), 1 - first / np.maximum(second, 1), 1.0)
                score = np.where(known > 0, np.clip((1 - first / np.maximum(known * size, 1)) * (0.5 + 0.5 * lead), 0, 1), 0.0)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(id_bucket("doc_id", 3) != 1))
    return identify(docs, profiles).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
