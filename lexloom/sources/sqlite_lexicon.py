"""A Spark data source for SQLite lexicon exports: `spark.read.format("sqlite-lexicon").option("table", t).load(file)`.

Tasks read disjoint rowid ranges of a read-only connection; rowid is exposed as the order of the source.
"""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"SQLite format 3\0"
# The tables and columns that an export must have.
REQUIRED = {
    "entries": ("id", "is_common", "data"),
    "forms": ("text", "entry_id", "is_kana", "is_common"),
    "jpn_defs": ("entry_id", "source", "glosses", "furigana"),
    "zh_defs": ("entry_id", "locale", "data"),
    "freq_rank": ("entry_id", "rank"),
    "vocab_jlpt": ("entry_id", "level", "source"),
    "meta": ("key", "value"),
    "table_licenses": ("table_name", "license", "source_db", "attribution"),
}
INTEGERS = {"is_common", "is_kana", "rank"}
LOCALE = "zh-CN"
ROWS = 200_000


class LexiconError(ValueError):
    pass


def connect(path: str) -> sqlite3.Connection:
    file = Path(path)
    if not file.is_file() or file.open("rb").read(16) != MAGIC:
        raise LexiconError(f"{path} is not an SQLite file")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.execute("PRAGMA query_only = ON")
    return con


def validate(path: str) -> None:
    """All required tables and columns are there (others may be too), and all definitions are of the one locale."""
    con = connect(path)
    for table, columns in REQUIRED.items():
        have = {r[1] for r in con.execute(f"SELECT * FROM pragma_table_info('{table}')")}
        if missing := [c for c in columns if c not in have]:
            raise LexiconError(f"{table} lacks {', '.join(missing)}")
    if other := [r[0] for r in con.execute("SELECT DISTINCT locale FROM zh_defs WHERE locale <> ?", (LOCALE,))]:
        raise LexiconError(f"unexpected locales: {other}")
    con.close()


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rowsPerPartition", ROWS))
        if self.table not in REQUIRED:
            raise LexiconError(f"unknown table {self.table}")

    def partitions(self):
        validate(self.path)
        con = connect(self.path)
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        con.close()
        return [_Rows(0, 0)] if low is None else [_Rows(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, part: _Rows):
        con = connect(self.path)
        yield from con.execute(f"SELECT rowid, {', '.join(REQUIRED[self.table])} FROM {self.table} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (part.low, part.high))
        con.close()


class SqliteLexiconSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite-lexicon"

    def schema(self) -> str:
        columns = REQUIRED[self.options["table"]]
        return ", ".join(["ord bigint", *[f"{c} {'int' if c in INTEGERS else 'string'}" for c in columns]])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(SqliteLexiconSource)
    return spark.read.format("sqlite-lexicon").option("table", table).option("rowsPerPartition", str(rows)).load(path)


def inspect(spark: SparkSession, path: str) -> dict:
    """Row counts of the six data tables, the meta map, and the licenses of the tables in order."""
    counts = {t: read(spark, path, t).count() for t in ("entries", "forms", "jpn_defs", "zh_defs", "freq_rank", "vocab_jlpt")}
    meta = {r.key: r.value for r in read(spark, path, "meta").collect()}
    licenses = read(spark, path, "table_licenses")
    return {"counts": counts, "meta": meta, "licenses": [r.asDict() for r in licenses.drop("ord").filter(licenses.table_name.isin(*counts)).orderBy("table_name").collect()]}
