"""A streaming source over logs of chunks: append-only files whose lines are JSON records of a chunk each.

`spark.readStream.format("chunk-log").load(folder)` gives log, position, request_id, seq and chunk (bytes; null ends a
request). An offset is how far each log has been taken, in bytes, always after a whole line: a record that is still being
written waits for a later batch. Ranges are cut into parts by bytes; a line belongs to the part in which it begins, so parts
are read by themselves and again, after a failure, with the same result.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sources import files

#: Endings of log files; those that Spark appends end as its text files do.
ENDINGS = (".log", ".txt")
#: Bytes of a log that one task reads, and bytes read at a time.
PART = 64 << 20
BLOCK = 1 << 20
SCHEMA = "log string, position bigint, request_id string, seq bigint, chunk binary"
COLUMNS = ["log", "position", "request_id", "seq", "chunk"]


class ChunkLogError(ValueError):
    pass


def logs(folder: str) -> dict[str, int]:
    """The bytes of each log."""
    system, path = files.opened(folder)
    if not files.exists(system, path):
        return {}
    return {n: files.size(system, f"{path}/{n}") for n in files.listed(system, path) if n.endswith(ENDINGS)}


def whole_lines(folder: str, name: str, size: int, block: int = BLOCK) -> int:
    """The end of the last whole line within the first `size` bytes of a log, found from the back."""
    system, path = files.opened(folder)
    end = size
    while end > 0:
        start = max(0, end - block)
        at = files.span(system, f"{path}/{name}", start, end).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


class Part(InputPartition):
    """The lines of a log that begin from `start` to `stop`; those of the whole range go from `first` to `end`."""

    def __init__(self, name: str, first: int, start: int, stop: int, end: int):
        self.name, self.first, self.start, self.stop, self.end = name, first, start, stop, end


def parts(name: str, first: int, end: int, size: int = PART) -> list[Part]:
    return [Part(name, first, at, min(at + size, end), end) for at in range(first, end, size)]


def lines_of(folder: str, part: Part, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in the part, read a block at a time. One that began before it is skipped."""
    system, path = files.opened(folder)
    with system.open_input_file(f"{path}/{part.name}") as f:
        at, held = part.start, b""
        if at > part.first and f.read_at(1, at - 1) != b"\n":
            while True:
                found = f.read_at(min(block, part.end - at), at)
                end = found.find(b"\n")
                if end >= 0:
                    at += end + 1
                    break
                at += len(found)
                if not found:
                    return
        begin, pieces = at, []
        while begin < part.stop:
            got = f.read_at(min(block, part.end - at), at)
            if not got:
                return
            at += len(got)
            *done, held = got.split(b"\n")
            for line in done:
                whole = b"".join([*pieces, line])
                pieces = []
                if begin < part.stop:
                    yield begin, whole
                begin += len(whole) + 1
            pieces.append(held)


def records(folder: str, part: Part) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for position, line in lines_of(folder, part):
        if not line.strip():
            continue
        try:
            r = json.loads(line)
            chunk = None if r["chunk"] is None else base64.b64decode(r["chunk"], validate=True)
            rows.append((part.name, position, str(r["request_id"]), int(r["seq"]), chunk))
        except (ValueError, KeyError, TypeError) as e:
            raise ChunkLogError(f"{part.name} at {position} is no record of a chunk") from e
        size += len(line)
        if size > BLOCK:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


class _Batch(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self):
        return [p for n, size in logs(self.folder).items() for p in parts(n, 0, whole_lines(self.folder, n, size), self.size)] or [Part("", 0, 0, 0, 0)]

    def read(self, partition: Part):
        return records(self.folder, partition) if partition.end else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {n: whole_lines(self.folder, n, size) for n, size in logs(self.folder).items()}

    def partitions(self, start: dict, end: dict):
        shrunk = [n for n in start if end.get(n, 0) < start[n]]
        if shrunk:
            raise ChunkLogError(f"{shrunk[0]} is shorter than what was read of it")
        return [p for n, to in sorted(end.items()) for p in parts(n, start.get(n, 0), to, self.size)]

    def read(self, partition: Part):
        return records(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


class ChunkLog(DataSource):
    """Option: bytesPerPartition. The driver holds a number for each log; a writer of many requests shares logs among them."""

    @classmethod
    def name(cls) -> str:
        return "chunk-log"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"].rstrip("/"), int(self.options.get("bytesPerPartition", PART))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._options())


def append_logs(chunks: DataFrame, folder: str, logs_written: int = 8) -> None:
    """Appends chunks (request_id, seq, chunk as bytes) to a folder of logs, in new files: each request's go to one of them,
    in their order."""
    record = F.to_json(F.struct("request_id", "seq", F.base64("chunk").alias("chunk")), {"ignoreNullFields": "false"})
    dealt = chunks.repartition(logs_written, "request_id").sortWithinPartitions("request_id", "seq")
    dealt.select(record.alias("value")).write.mode("append").option("lineSep", "\n").format("text").save(folder)
