import os

import pytest
from pyspark.sql import functions as F

from lexloom.sources import ledger


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, v string")


def held(spark, folder):
    return sorted((r.k, r.v, r.ledger_batch) for r in ledger.read(spark, folder).collect())


def test_batches_count_once_and_in_order(spark, tmp_path):
    folder = str(tmp_path / "l")
    ledger.append(rows(spark, (1, "a"), (2, "b")), folder, "10")
    ledger.append(rows(spark, (1, "c")), folder, "9")
    ledger.append(rows(spark, (7, "again")), folder, "9")  # the batch is there: nothing is written
    assert held(spark, folder) == [(1, "a", 1), (1, "c", 0), (2, "b", 1)]
    written = [f"data/{a}/{f}" for a in os.listdir(f"{folder}/data") for f in os.listdir(f"{folder}/data/{a}") if f.endswith(".parquet")]
    assert sorted(written) == sorted(f for e in ledger.entries(folder) for f in e["files"]) and ledger.vacuum(folder) == 0
    last = ledger.snapshot(ledger.read(spark, folder), "k")
    first = ledger.snapshot(ledger.read(spark, folder), "k", keep="first")
    assert sorted(map(tuple, last.collect())) == [(1, "a"), (2, "b")] and sorted(map(tuple, first.collect())) == [(1, "c"), (2, "b")]
    assert [tuple(r) for r in ledger.conflicts(ledger.read(spark, folder), "k").collect()] == [(1, 2)]
    ledger.append(rows(spark, (5, None)), folder, "11", replace=True)
    assert held(spark, folder) == [(5, None, 0)]


def test_a_failed_task_leaves_nothing_and_a_rerun_writes_once(spark, tmp_path):
    folder = str(tmp_path / "l")
    bad = spark.range(100).repartition(4).select(F.col("id").alias("k"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        ledger.append(bad, folder, "1")
    ledger.vacuum(folder)
    assert ledger.entries(folder) == [] and os.listdir(f"{folder}/data") == []
    with pytest.raises(ledger.LedgerError, match="no batch"):
        ledger.read(spark, folder)
    for _ in range(2):
        ledger.append(spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("v")), folder, "1")
    assert ledger.read(spark, folder).count() == 100 and len(os.listdir(f"{folder}/data")) == 1


def test_empty_batches_new_columns_and_names(spark, tmp_path):
    folder = str(tmp_path / "l")
    ledger.append(rows(spark).limit(0), folder, "1")
    assert ledger.read(spark, folder).count() == 0
    ledger.append(rows(spark, (1, "a")), folder, "2")
    ledger.append(rows(spark, (2, "b")).withColumn("new", F.lit(1)), folder, "word")
    assert sorted(map(tuple, ledger.read(spark, folder).select("k", "v", "new").collect())) == [(1, "a", None), (2, "b", 1)]
    for name in ("", "a/b"):
        with pytest.raises(Exception, match="name without slashes"):
            ledger.append(rows(spark, (1, "a")), folder, name)
    with pytest.raises(ledger.LedgerError):
        ledger.snapshot(ledger.read(spark, folder), "k", keep="any")


def test_a_stream_that_is_run_again_writes_once(spark, tmp_path):
    """The second run has lost its checkpoint's last commit, so the same batch comes again."""
    (tmp_path / "in").mkdir()
    rows(spark, (1, "a"), (2, "b")).write.mode("append").parquet(str(tmp_path / "in"))
    spark.dataSource.register(ledger.Ledger)

    def run():
        stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("ledger").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "l"))
        assert q.awaitTermination(120) and q.exception() is None

    run()
    for name in os.listdir(tmp_path / "cp/commits"):
        (tmp_path / "cp/commits" / name).unlink()
    run()
    rows(spark, (3, "c")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert held(spark, str(tmp_path / "l")) == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]


def test_reports_are_documents(spark, tmp_path):
    ledger.report(rows(spark, (1, "a")), str(tmp_path / "l"), "sizes")
    assert ledger.read(spark, str(tmp_path / "l")).first()["document"] == '{"k":1,"v":"a"}'
