"""A sink that takes each batch of rows once: format `ledger`, for batch writes and streams.

Tasks write Parquet files into the ledger's folder under names of their own; nothing there counts until the commit writes
the batch's entry, under another name first and then moved: the list of its files. A batch whose entry is there already is
taken as written, and the files of the second attempt are removed, so a job that is run again after it failed anywhere writes
once. An aborted batch removes its files; what executors leave that were lost meanwhile is never read, and goes by `vacuum`.
Streams use their batch number, batch writes name
theirs (option `batch`); entries are ordered by that name, numbers before words.

Inserts that skip what is there, upserts and replaced snapshots are ways of reading it: of rows with one key, that of the
first batch or the last counts, and a batch marked `replace` hides those before it. Reports are batches of one row.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files

BATCH = "ledger_batch"


class LedgerError(ValueError):
    pass


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def entry_name(batch: str) -> str:
    """Names that sort as batches follow each other."""
    if not batch or "/" in batch:
        raise LedgerError("a batch needs a name without slashes")
    return f"0{int(batch):020d}.json" if batch.isdigit() else f"1{batch}.json"


class _Write:
    def __init__(self, options: dict, schema: StructType, replace: bool, stream: bool):
        self.folder, self.ddl, self.replace, self.batch = options["path"].rstrip("/"), schema.json(), replace, options.get("batch", "")
        if not stream:
            entry_name(self.batch)
        # Files lie in a folder of the attempt that wrote them, which goes when it is aborted.
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = files.opened(self.folder)
        system.create_dir(f"{root}/data/{self.attempt}")
        name = f"data/{self.attempt}/{uuid.uuid4().hex}.parquet"
        out, rows = None, 0
        try:
            for batch in iterator:
                if out is None:
                    stream = system.open_output_stream(f"{root}/{name}")
                    out = pq.ParquetWriter(stream, batch.schema, compression="snappy")
                out.write_batch(batch)
                rows += batch.num_rows
            if out is not None:
                out.close()
                stream.close()
        except BaseException:
            if out is not None:
                with contextlib.suppress(Exception):
                    stream.close()
                with contextlib.suppress(OSError):
                    system.delete_file(f"{root}/{name}")
            raise
        return Written(name if rows else "", rows)

    def _commit(self, messages, batch: str) -> None:
        system, root = files.opened(self.folder)
        path = f"{root}/log/{entry_name(batch)}"
        if files.exists(system, path):
            self._abort()
            return
        system.create_dir(f"{root}/log")
        done = [m for m in messages if m is not None and m.file]
        entry = {"batch": batch, "replace": self.replace, "schema": json.loads(self.ddl), "rows": sum(m.rows for m in done), "files": sorted(m.file for m in done)}
        files.put(system, path, json.dumps(entry).encode())

    def _abort(self) -> None:
        system, root = files.opened(self.folder)
        if files.exists(system, f"{root}/data/{self.attempt}"):
            system.delete_dir(f"{root}/data/{self.attempt}")


class _BatchWriter(_Write, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages) -> None:
        self._abort()


class _StreamWriter(_Write, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, str(batchId))

    def abort(self, messages, batchId: int) -> None:
        self._abort()


class Ledger(DataSource):
    """Options: batch (its name, for batch writes). Overwriting writes a batch that hides those before it."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        raise LedgerError("a ledger is read by ledger.read")

    def writer(self, schema: StructType, overwrite: bool):
        return _BatchWriter(self.options, schema, overwrite, False)

    def streamWriter(self, schema: StructType, overwrite: bool):
        return _StreamWriter(self.options, schema, False, True)


def append(rows: DataFrame, folder: str, batch: str, replace: bool = False) -> None:
    """Writes a batch, unless one of that name is there."""
    rows.sparkSession.dataSource.register(Ledger)
    rows.write.format("ledger").mode("overwrite" if replace else "append").option("batch", batch).save(folder)


def _all_entries(system, root: str) -> list[dict]:
    if not files.exists(system, f"{root}/log"):
        return []
    return [json.loads(files.span(system, f"{root}/log/{n}")) for n in files.listed(system, f"{root}/log") if n.endswith(".json")]


def entries(folder: str) -> list[dict]:
    """The batches that count, in order: those from the last replacing one on."""
    found = _all_entries(*files.opened(folder))
    last = max((i for i, e in enumerate(found) if e["replace"]), default=0)
    return found[last:]


def vacuum(folder: str) -> int:
    """Removes the files of attempts that no batch names, and says of how many; no batch may be written meanwhile."""
    system, root = files.opened(folder)
    known = {f.split("/")[1] for e in _all_entries(system, root) for f in e["files"]}
    lost = [n for n in (files.listed(system, f"{root}/data") if files.exists(system, f"{root}/data") else []) if n not in known]
    for n in lost:
        system.delete_dir(f"{root}/data/{n}")
    return len(lost)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the batches that count, with their batch's place among them. An empty ledger has no schema: an error."""
    found = entries(folder)
    if not found:
        raise LedgerError(f"{folder} has no batch")
    schema = StructType.fromJson(found[-1]["schema"])
    parts = []
    for i, e in enumerate(found):
        if e["files"]:
            rows = spark.read.schema(StructType.fromJson(e["schema"])).parquet(*(f"{folder}/{f}" for f in e["files"]))
            parts.append(rows.withColumn(BATCH, F.lit(i)))
    if not parts:
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def snapshot(rows: DataFrame, *keys: str, keep: str = "last") -> DataFrame:
    """Of the rows of `read`, one a key: that of the last batch (an upsert) or of the first (an insert that skips what is
    there). Of rows with one key in one batch, the least counts, so the choice never depends on their order."""
    if keep not in ("first", "last"):
        raise LedgerError("keep the first or the last")
    batch = F.col(BATCH).desc() if keep == "last" else F.col(BATCH)
    rest = [F.col(f"`{c}`").asc_nulls_first() for c in rows.columns if c not in (*keys, BATCH)]
    best = Window.partitionBy(*keys).orderBy(batch, *rest)
    return rows.withColumn("ledger_n", F.row_number().over(best)).filter("ledger_n = 1").drop("ledger_n", BATCH)


def conflicts(rows: DataFrame, *keys: str) -> DataFrame:
    """keys of the rows of `read` that batches tell differently, and in how many ways."""
    values = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in (*keys, BATCH)))
    return rows.groupBy(*keys).agg(F.count_distinct(values).alias("ways")).filter("ways > 1")


def report(parts: DataFrame, folder: str, name: str) -> None:
    """Appends a report, a table of few rows, as one batch whose rows are JSON documents."""
    append(parts.select(F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("document")), folder, name)
