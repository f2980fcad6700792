"""The clustered store and the containers that are written here: what they return, and how little they read."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from lexloom.operators import search
from lexloom.sources import lookup_store, stardict, stardict_writer

ENTRY = "id long, dictionary_id string, headword_normalized string, sort_key string, source_ordinal long"


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 4))) for _ in range(700)] + ["same"] * 900
    return spark.createDataFrame([(i, f"d{rng.randint(1, 4)}", w, w, i) for i, w in enumerate(words)] + [(9999, None, None, None, 1)], ENTRY).cache()


@pytest.fixture(scope="module")
def store(spark, entries, tmp_path_factory):
    return lookup_store.write(entries, str(tmp_path_factory.mktemp("store") / "s"), shards=12)


def files_read(df):
    """Parquet files that the scans of a query open."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_store_answers_as_the_table(entries, store):
    for dictionary, word in (("d1", "same"), ("d2", "a"), ("d3", "漢"), ("d4", "é"), ("d1", "zzz"), ("d9", "a")):
        assert store.exact(dictionary, word).collect() == search.exact(entries, dictionary, word).collect()
        assert store.prefix(dictionary, word).collect() == search.prefix(entries, dictionary, word).collect()
    wanted = entries.filter("id % 50 = 0")
    assert sorted(r.id for r in store.lookup(wanted).collect()) == sorted(r.id for r in entries.join(wanted.select(*lookup_store.KEYS).distinct(), list(lookup_store.KEYS), "left_semi").collect())
    assert store.lookup(entries.filter("id < 0")).count() == 0 and store.rows.count() == entries.count()


def test_a_lookup_opens_few_files(entries, store):
    assert files_read(store.rows) >= 12
    assert files_read(store.exact("d2", "ab")) <= 2
    assert files_read(store.prefix("d3", "c")) <= 3
    same = F.struct(F.lit("d1").alias("dictionary_id"), F.lit("same").alias("headword_normalized"))
    spread = store.manifest.filter((F.col("least") <= same) & (F.col("greatest") >= same)).count()
    assert spread > 1  # a frequent headword doesn't fill one shard
    assert "PushedFilters: [IsNotNull(dictionary_id)" in store.exact("d2", "ab")._jdf.queryExecution().toString()


def test_many_lookups_without_a_list(entries, store, monkeypatch):
    monkeypatch.setattr(lookup_store, "LISTED", 1)
    assert store.prefix("d1", "s").count() == search.prefix(entries, "d1", "s").count() > 100
    assert store.lookup(entries.filter("id % 50 = 0")).count() > 100


def test_an_unfinished_store_is_none(spark, entries, store, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        lookup_store.open_store(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        lookup_store.write(entries, store.path)
    with pytest.raises(ValueError, match="store_shard"):
        lookup_store.write(entries.withColumn("Store_Shard", F.lit(1)), str(tmp_path / "x"))


RNG = random.Random(8)
RECORDS = [(w, f"{w} 余味 {i}") for i, w in enumerate(sorted({"".join(RNG.choices("abAB é", k=1 + i % 5)) for i in range(900)}))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("containers") / "c")
    stardict_writer.write_containers(spark.createDataFrame(RECORDS * 3, "headword string, text string"), folder, containers=3)
    return folder


def of_all(folder, *filters):
    reader = stardict._LookupReader({"path": folder, "rowsPerPartition": "32"})
    assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark checks them again
    return [row for p in reader.partitions() for row in reader.read(p)], reader


def test_containers_hold_all_records_in_order(spark, folder):
    rows, _ = of_all(folder)
    assert sorted((r[1], r[4]) for r in rows) == sorted(RECORDS * 3)
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert [stardict.order(r[1]) for r in rows] == sorted(stardict.order(w) for w, _ in RECORDS * 3)
    assert spark.read.format("stardict").load(folder).count() == len(rows)
    for box, *_ in stardict.containers(folder):
        one = stardict.open_container(box)
        assert stardict.offset_index_faults(one) == [] and len(stardict.check(one)) == int(one.info["wordcount"])


def test_conditions_find_their_records(folder):
    words = sorted({w for w, _ in RECORDS})
    for w in [*words[::9], "zz", "0", "A", "é"]:
        got, _ = of_all(folder, EqualTo(("headword",), w))
        assert sorted((r[1], r[4]) for r in got) == sorted(x for x in RECORDS * 3 if x[0] == w)
        got, _ = of_all(folder, StringStartsWith(("headword",), w[:2]), EqualTo(("other",), 1))
        assert sorted((r[1], r[4]) for r in got) == sorted(x for x in RECORDS * 3 if x[0].startswith(w[:2]))
    got, _ = of_all(folder, In(("headword",), (words[3], None, words[40], "zz")))
    assert sorted(r[1] for r in got) == sorted([words[3], words[40]] * 3)


def test_a_lookup_reads_little_of_the_index(folder, monkeypatch):
    read = []
    was = stardict.files.span
    monkeypatch.setattr(stardict.files, "span", lambda system, path, start=0, end=None: read.append((path, len(data := was(system, path, start, end)))) or data)
    _, reader = of_all(folder, EqualTo(("headword",), RECORDS[100][0]))
    index = sum(n for path, n in read if path.endswith(".idx"))
    total = sum(os.path.getsize(f"{box}/lexicon.idx") for box, *_ in stardict.containers(folder))
    assert index < total / 3 and len(reader.partitions()) <= 2


def test_foreign_containers_are_walked_in_blocks(tmp_path):
    from .test_sources import container

    container(tmp_path, [(f"w{i}" * (1 + i % 9), "x") for i in range(500)], bits=64)
    box = stardict.open_container(str(tmp_path))
    for block in (7, 64, 1 << 20):
        starts, n = stardict.starts_of(box, 10, block)
        assert n == 500 and starts == [at for i, (_, _, _, at) in enumerate(stardict.parse_index(box.index(), 64)) if i % 10 == 0]
    (tmp_path / "f.idx").write_bytes(box.index()[:-1])
    with pytest.raises(stardict.StarDictError, match="truncated"):
        stardict.starts_of(box, 10, 64)


def test_a_failed_write_leaves_nothing_and_a_second_replaces(spark, tmp_path):
    folder = str(tmp_path / "c")
    rows = spark.createDataFrame(RECORDS, "headword string, text string")
    with pytest.raises(Exception, match="a null in record"):
        stardict_writer.write_containers(rows.withColumn("text", F.when(F.col("headword") != RECORDS[70][0], F.col("text"))), folder, containers=3)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    for _ in range(2):
        stardict_writer.write_containers(rows, folder, containers=2)
        assert len(os.listdir(folder)) == 2 and len(of_all(folder)[0]) == len(RECORDS)
    with pytest.raises(Exception, match="holds containers already"):
        stardict_writer.write_containers(rows, folder, mode="append")
    with pytest.raises(Exception, match="out of order"):
        rows.coalesce(1).orderBy(F.desc("headword")).write.format("stardict").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 2 and len(of_all(folder)[0]) == len(RECORDS)
    stardict_writer.write_containers(rows.limit(0), str(tmp_path / "empty"))
    assert of_all(str(tmp_path / "empty"))[0] == []
