import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.llm import language_id as li

from .edges import documents, no_documents


def plain_grams(text):
    cleaned = "".join(c.lower() if c.isalpha() else " " for c in text)
    padded = " " + " ".join(cleaned.split()) + " "
    if not padded.strip():
        return Counter()
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                out[g] += 1
    return out


def unpack(gram):
    return "".join(chr(c) for c in ((gram >> 32) & 0xFFFF, (gram >> 16) & 0xFFFF, gram & 0xFFFF) if c)


def test_grams_are_those_of_padded_words():
    texts = ["The  cat, the dog!", "", "naïve Ñandú", "x", "12 34", "\U0001f600 \U0001f600"]
    row, gram, n = li.grams(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        got = {unpack(g): c for r, g, c in zip(row.tolist(), gram.tolist(), n.tolist(), strict=True) if r == i}
        assert got == dict(plain_grams(t))


def test_out_of_place_distance_by_hand():
    keys = sorted(li.grams(pa.array(["ab ab"], pa.large_string()))[1].tolist())
    import numpy as np

    tables = [(np.array(keys), np.arange(len(keys)))]
    far, known = li.distances(pa.array(["ab ab"], pa.large_string()), tables, 300)
    assert known.tolist() == [len(keys)]
    counts = dict(zip(li.grams(pa.array(["ab ab"], pa.large_string()))[1].tolist(), li.grams(pa.array(["ab ab"], pa.large_string()))[2].tolist(), strict=True))
    order = sorted(keys, key=lambda g: (-counts[g], g))
    assert far[0, 0] == sum(abs(keys.index(g) - order.index(g)) for g in order)


def test_held_out_accuracy(spark, small_dir):
    got = li.op4_language_id(spark, small_dir).join(spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def packed(g):
    return int.from_bytes(g.encode("utf-16-be"), "big")


def ranking(counts, size=li.PROFILE):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size])}


def test_the_whole_query_is_a_plain_version(spark, small_dir):
    """Profiles of the learned documents, rankings and distances, with nothing but dictionaries."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None:
            learned.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {lang: ranking(c) for lang, c in sorted(learned.items())}
    got = {r.doc_id: r for r in li.op4_language_id(spark, small_dir).collect()}
    for r in docs:
        mine = ranking(plain_grams(r.text or ""))
        far = {lang: sum(abs(p[g] - i) if g in p else li.PROFILE for g, i in mine.items()) for lang, p in profiles.items()}
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert got[r.doc_id].lang_pred == (min(far, key=far.get) if any(c.isalpha() for c in r.text or "") else "und")


def test_marks_and_digits_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "\u0301\u0302 12", None), (3, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(docs, li.learn_profiles(docs)).collect()}
    assert got[1][0] == "en" and got[2] == got[3] == ("und", 0.0)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in li.identify(docs, li.learn_profiles(docs)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 8))
    assert got[9].lang_pred == "es" and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in li.identify(docs, {}).collect()} == {"und"}
    assert li.learn_profiles(no_documents(spark)) == {}
    assert li.identify(no_documents(spark), {}).count() == 0
