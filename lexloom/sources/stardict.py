"""A Spark data source for StarDict containers: `spark.read.format("stardict").load(folder)`.

The folder holds one container, or a manifest of many that `stardict_writer` made. The driver reads headers and, from the
list of every 32nd record's start beside an index, only where partitions begin; an index without that list is walked once,
in blocks. Each task reads its own range of the index, and of the payload only the runs of bytes that its records take: by
seeking in a plain payload, by the chunk table of one compressed for random access. A payload that is plain gzip is unpacked
once in each task, as it has no other way in.

Read by `for_lookups`, conditions on the headword (equal, one of, begins with) are pushed into the source: where the list is
there, a binary search over it finds the records, as the format orders them, and only these are read.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from . import files

HEADER = "StarDict's dict ifo file"
LARGEST_OFFSET = (1 << 53) - 1
LARGEST_INDEX = LARGEST_PAYLOAD = (1 << 32) - 1
RECORDS = 100_000
# An offset index begins with this line and four more bytes, and lists the start of every 32nd record.
CACHE_HEADER, CACHE_OPAQUE, STRIDE = b"StarDict's Cache, Version: 0.2", 4, 32
#: Lists the containers of a folder that holds many.
MANIFEST = "containers.json"


class StarDictError(ValueError):
    pass


def parse_ifo(text: str) -> dict[str, str]:
    lines = text.removeprefix("﻿").splitlines()
    if not lines or lines[0].strip() != HEADER:
        raise StarDictError("not a StarDict header")
    out = {}
    for line in filter(str.strip, lines[1:]):
        key, sign, value = line.partition("=")
        if not sign or not key:
            raise StarDictError(f"malformed header line: {line}")
        out[key.strip()] = value.strip()
    return out


def parse_index(data: bytes, bits: int) -> Iterator[tuple[str, int, int, int]]:
    """(headword, offset, size, start of the record in the index) of every record."""
    layout = struct.Struct(">QI" if bits == 64 else ">II")
    at = 0
    while at < len(data):
        end = data.find(b"\0", at)
        if end < 0 or end + 1 + layout.size > len(data):
            raise StarDictError(f"truncated index record at {at}")
        try:
            word = data[at:end].decode("utf-8")
        except UnicodeDecodeError as e:
            raise StarDictError(f"headword at {at} is not UTF-8") from e
        offset, size = layout.unpack_from(data, end + 1)
        yield word, offset, size, at
        at = end + 1 + layout.size


@dataclass
class Container:
    base: str
    info: dict[str, str]
    system: object = field(default=None, repr=False)

    def __post_init__(self):
        if self.system is None:
            self.system, self.base = files.opened(self.base)

    @property
    def bits(self) -> int:
        return int(self.info.get("idxoffsetbits", "32"))

    def has(self, ending: str) -> bool:
        return files.exists(self.system, self.base + ending)

    def index_size(self) -> int:
        return files.size(self.system, f"{self.base}.idx")

    def index(self, start: int = 0, end: int | None = None) -> bytes:
        return files.span(self.system, f"{self.base}.idx", start, end)

    def payload(self) -> bytes:
        if self.has(".dict"):
            return files.span(self.system, f"{self.base}.dict")
        return gzip.decompress(files.span(self.system, f"{self.base}.dict.dz"))

    @cached_property
    def chunks(self) -> tuple[int, list[int]] | None:
        return chunk_table(files.span(self.system, f"{self.base}.dict.dz", 0, 1 << 17))

    @cached_property
    def unpacked(self) -> bytes:
        return self.payload()

    def span(self, start: int, end: int) -> bytes:
        """The payload's bytes from start to end, as far as there are any."""
        if self.has(".dict"):
            return files.span(self.system, f"{self.base}.dict", start, end)
        if self.chunks is None:
            return self.unpacked[start:end]
        length, places = self.chunks
        first, last = start // length, min(-(-end // length), len(places) - 1)
        if first >= last:
            return b""
        packed = files.span(self.system, f"{self.base}.dict.dz", places[first], places[last])
        parts = (packed[places[k] - places[first] : places[k + 1] - places[first]] for k in range(first, last))
        out = b"".join(zlib.decompressobj(-15).decompress(p) for p in parts)
        return out[start % length : start % length + max(0, end - start)]

    def payload_size(self) -> int:
        return files.size(self.system, f"{self.base}.dict") if self.has(".dict") else len(self.unpacked)


def chunk_table(head: bytes) -> tuple[int, list[int]] | None:
    """The length of a chunk unpacked, and the places of all chunks and their end, of a gzip file made for random
    access: its extra field RA lists the packed sizes. None for other files."""
    if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    size = struct.unpack_from("<H", head, 10)[0]
    at, end, found = 12, 12 + size, None
    while at + 4 <= end:
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"RA":
            _, length, count = struct.unpack_from("<HHH", head, at + 4)
            found = length, struct.unpack_from(f"<{count}H", head, at + 10)
        at += 4 + n
    if found is None:
        return None
    for flag in (8, 16):  # name and comment end in a zero byte
        if head[3] & flag:
            end = head.index(b"\0", end) + 1
    places = [end + 2 * bool(head[3] & 2)]
    for n in found[1]:
        places.append(places[-1] + n)
    return found[0], places


def open_container(folder: str) -> Container:
    system, folder = files.opened(folder)
    found = [n for n in files.listed(system, folder) if n.endswith(".ifo")]
    if len(found) != 1:
        raise StarDictError(f"{len(found)} .ifo files in {folder}, where one is due")
    base = f"{folder.rstrip('/')}/{found[0].removesuffix('.ifo')}"
    info = parse_ifo(files.span(system, f"{base}.ifo").decode("utf-8"))
    if info.get("sametypesequence") != "m":
        raise StarDictError("only payloads of type m are read")
    return Container(base, info, system)


def check(container: Container) -> list[tuple[str, int, int, int]]:
    """The index, held against the header and the payload's size."""
    data = container.index()
    if "idxfilesize" in container.info and int(container.info["idxfilesize"]) != len(data):
        raise StarDictError("idxfilesize differs from the index")
    records = list(parse_index(data, container.bits))
    if "wordcount" in container.info and int(container.info["wordcount"]) != len(records):
        raise StarDictError("wordcount differs from the index")
    size = container.payload_size()
    for word, offset, length, _ in records:
        if offset > LARGEST_OFFSET or offset + length > size:
            raise StarDictError(f"record {word} lies outside of the payload")
    return records


def offset_index_faults(container: Container) -> list[str]:
    """What a `.idx.oft` file, if there is one, gets wrong: it has a header, and lists as little-endian numbers every
    32nd record's start and then the end of the index."""
    if not container.has(".idx.oft"):
        return []
    data = files.span(container.system, f"{container.base}.idx.oft")
    begin = len(CACHE_HEADER) + CACHE_OPAQUE
    if not data.startswith(CACHE_HEADER) or len(data) < begin:
        return ["unexpected header"]
    if (len(data) - begin) % 4:
        return ["the list's length is no multiple of four"]
    listed = [x for (x,) in struct.iter_unpack("<I", data[begin:])]
    index = container.index()
    due = [at for i, (_, _, _, at) in enumerate(parse_index(index, container.bits)) if i % STRIDE == 0] + [len(index)]
    wrong = sum(a != b for a, b in zip(listed, due, strict=False)) + abs(len(listed) - len(due))
    return [f"{wrong} of {len(due)} entries differ"] if wrong else []


def folded(word: bytes) -> bytes:
    """ASCII letters made small; the format orders by this, then by the bytes themselves."""
    return word.lower() if word.isascii() else re.sub(rb"[A-Z]+", lambda m: m[0].lower(), word)


def order(word: str) -> tuple[bytes, bytes]:
    raw = word.encode("utf-8")
    return folded(raw), raw


class SparseIndex:
    """The list of every 32nd record's start, read entry by entry where it lies."""

    def __init__(self, container: Container):
        self.container, self.path = container, f"{container.base}.idx.oft"
        self.begin = len(CACHE_HEADER) + CACHE_OPAQUE
        size = files.size(container.system, self.path)
        if not files.span(container.system, self.path, 0, self.begin).startswith(CACHE_HEADER) or (size - self.begin) % 4:
            raise StarDictError("the list of record starts is malformed")
        self.blocks = max(0, (size - self.begin) // 4 - 1)

    def start(self, block: int) -> int:
        """Where in the index a block of 32 records begins; the block after the last is the index's end."""
        at = self.begin + 4 * min(block, self.blocks)
        return struct.unpack("<I", files.span(self.container.system, self.path, at, at + 4))[0]

    def first_word(self, block: int) -> tuple[bytes, bytes]:
        at, end = self.start(block), self.start(block + 1)
        head = self.container.index(at, min(end, at + 512))
        if b"\0" not in head:
            head = self.container.index(at, end)
        raw = head[: head.index(b"\0")]
        return folded(raw), raw

    def first_block(self, least: tuple[bytes, bytes]) -> int:
        """The block in which the first word from `least` on lies, or one before it."""
        low, high = 0, self.blocks
        while low < high:
            mid = (low + high) // 2
            if self.first_word(mid) < least:
                low = mid + 1
            else:
                high = mid
        return max(0, low - 1)

    def end_block(self, beyond, from_block: int) -> int:
        """The first block from there on whose first word lies beyond, as a test of its order says."""
        low, high = from_block, self.blocks
        while low < high:
            mid = (low + high) // 2
            if beyond(self.first_word(mid)):
                high = mid
            else:
                low = mid + 1
        return low


def starts_of(container: Container, every: int, block: int = 1 << 20) -> tuple[list[int], int]:
    """The starts of every so many records, and how many there are, by a walk through the index a block at a time."""
    tail, starts, n, at = (12 if container.bits == 64 else 8), [], 0, 0
    size, read, held = container.index_size(), 0, b""
    while True:
        zero = held.find(b"\0", at)
        if zero < 0 or zero + 1 + tail > len(held):
            if read >= size:
                break
            held = held[at:] + container.index(read, read + block)
            at, read = 0, min(size, read + block)
            continue
        if n % every == 0:
            starts.append(read - len(held) + at)
        n, at = n + 1, zero + 1 + tail
    if at < len(held):
        raise StarDictError(f"truncated index record at {read - len(held) + at}")
    return starts, n


@dataclass(frozen=True)
class Wanted:
    """What conditions on the headword ask for: certain words, or those that begin so."""

    words: tuple[str, ...] | None = None
    prefix: str | None = None

    def keeps(self, word: str) -> bool:
        return (self.words is None or word in self.words) and (self.prefix is None or word.startswith(self.prefix))

    def ranges(self) -> list[tuple[tuple[bytes, bytes], object]]:
        """For each stretch of the order that may hold a word: where it begins, and the test of what lies beyond it."""
        if self.words is not None:
            return [(order(w), lambda key, last=order(w): key > last) for w in sorted(self.words, key=order) if self.prefix is None or w.startswith(self.prefix)]
        small = folded(self.prefix.encode("utf-8"))
        return [((small, b""), lambda key: key[0] > small and not key[0].startswith(small))]

    def meets(self, first: str, last: str) -> bool:
        """Whether a container from the word `first` to the word `last` may hold one."""
        return any(low <= order(last) and not beyond(order(first)) for low, beyond in self.ranges())


class _Range(InputPartition):
    """Records of one container from the number `first` on, `due` of them (None: unknown), in the index from byte `start`
    to `end`; `before`: the records of the containers before it."""

    def __init__(self, folder: str, first: int, start: int, end: int, before: int = 0, due: int | None = None):
        self.folder, self.first, self.start, self.end, self.before, self.due = folder, first, start, end, before, due


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.lenient = options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.rows = max(1, int(options.get("rowsPerPartition", RECORDS)))
        self.wanted: Wanted | None = None

    def partitions(self):
        found = []
        for folder, before, first, last in containers(self.folder):
            if self.wanted is None or first is None or self.wanted.meets(first, last):
                found += self._of(folder, before)
        return found or [_Range(self.folder, 0, 0, 0)]

    def _of(self, folder: str, before: int) -> list[_Range]:
        container = open_container(folder)
        size = container.index_size()
        if not self.lenient and int(container.info.get("idxfilesize", size)) != size:
            raise StarDictError("idxfilesize differs from the index")
        if not container.has(".idx.oft"):
            if not size:
                return []
            starts, n = starts_of(container, self.rows)
            if not self.lenient and int(container.info.get("wordcount", n)) != n:
                raise StarDictError("wordcount differs from the index")
            return [_Range(folder, i * self.rows, a, b, before) for i, (a, b) in enumerate(zip(starts, [*starts[1:], size], strict=True))]
        sparse = SparseIndex(container)
        n = int(container.info["wordcount"]) if "wordcount" in container.info else None
        if not self.lenient and (sparse.start(sparse.blocks) != size or (n is not None and -(-n // STRIDE) != sparse.blocks)):
            raise StarDictError("the list of record starts differs from the index")
        step, out, done = max(1, self.rows // STRIDE), [], 0
        for a, b in [(0, sparse.blocks)] if self.wanted is None else self._blocks(sparse):
            a = max(a, done)
            for k in range(a, b, step):
                to = min(k + step, b)
                due = None if n is None else min(n, to * STRIDE) - k * STRIDE
                out.append(_Range(folder, k * STRIDE, sparse.start(k), sparse.start(to), before, due))
            done = max(done, b)
        return out

    def _blocks(self, sparse: SparseIndex) -> Iterator[tuple[int, int]]:
        for least, beyond in self.wanted.ranges():
            first = sparse.first_block(least)
            yield first, sparse.end_block(beyond, first)

    def read(self, partition: _Range):
        if partition.start == partition.end:
            return
        container = open_container(partition.folder)
        records = [(i, *r) for i, r in enumerate(parse_index(container.index(partition.start, partition.end), container.bits))]
        if not self.lenient and partition.due is not None and partition.due != len(records):
            raise StarDictError("wordcount differs from the index")
        if self.wanted is not None:
            records = [r for r in records if self.wanted.keeps(r[1])]
        for begin, payload, run in runs(container, records):
            for i, word, offset, size, _ in run:
                raw, error = payload[offset - begin : offset - begin + size], None
                if len(raw) < size or offset > LARGEST_OFFSET:
                    error = "outside of the payload"
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text, error = raw.decode("utf-8", "replace"), "payload is not UTF-8"
                if error and not self.lenient:
                    raise StarDictError(f"record {word}: {error}")
                yield (partition.before + partition.first + i, word, offset, size, text, error)


class _LookupReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes note of conditions on the headword; all are left for Spark to check again."""
        words, prefix = None, None
        for f in filters:
            if getattr(f, "attribute", None) != ("headword",):
                continue
            if isinstance(f, EqualTo) and f.value is not None:
                words = (f.value,)
            elif isinstance(f, In) and words is None:
                words = tuple({v for v in f.value if v is not None})
            elif isinstance(f, StringStartsWith) and f.value:
                prefix = f.value
        if words is not None or prefix is not None:
            self.wanted = Wanted(words, prefix)
        return filters


def runs(container: Container, records: list[tuple], most: int = 8 << 20) -> Iterator[tuple[int, bytes, list[tuple]]]:
    """Records in groups whose payloads lie together, with the bytes read for each: (where they begin, bytes, records).
    Records (number, word, offset, size, place) come in their order; payloads far from each other aren't read through."""
    at = 0
    while at < len(records):
        begin, end, to = records[at][2], records[at][2] + records[at][3], at + 1
        while to < len(records):
            offset, stop = records[to][2], records[to][2] + records[to][3]
            low, high = min(begin, offset), max(end, stop)
            if high - low > most or offset > end + (1 << 16) or stop < begin - (1 << 16):
                break
            begin, end, to = low, high, to + 1
        yield begin, container.span(begin, end), records[at:to]
        at = to


def containers(folder: str) -> list[tuple[str, int, str | None, str | None]]:
    """(folder, records before it, first word, last word) of the containers of a manifest, or the one in the folder itself."""
    system, path = files.opened(folder)
    name = f"{path.rstrip('/')}/{MANIFEST}"
    if not files.exists(system, name):
        return [(folder, 0, None, None)]
    out, before = [], 0
    for part in json.loads(files.span(system, name))["containers"]:
        out.append((f"{folder.rstrip('/')}/{part['folder']}", before, part["first"], part["last"]))
        before += part["records"]
    return out


@dataclass
class Written(WriterCommitMessage):
    folder: str
    first: str
    last: str
    records: int


class ContainerWriter(DataSourceArrowWriter):
    """Takes columns headword and text; each task's rows must come in the format's order, and neither may be null."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.name, self.overwrite = options["path"].rstrip("/"), options.get("bookname", "lexicon"), overwrite
        self.write_id = f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = files.opened(self.folder)
        own = f"{self.write_id}/{uuid.uuid4().hex}"
        try:
            return self._container(system, f"{root}/{own}", own, iterator)
        except BaseException:
            with contextlib.suppress(OSError):
                system.delete_dir(f"{root}/{own}")
            raise

    def _container(self, system, path: str, own: str, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system.create_dir(path)
        first = last = before = None
        n = place = offset = 0
        starts = []
        with system.open_output_stream(f"{path}/lexicon.idx") as index, system.open_output_stream(f"{path}/lexicon.dict") as payload:
            for batch in batches:
                for word, text in zip(batch.column("headword").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if word is None or text is None:
                        raise StarDictError(f"a null in record {n}")
                    raw, data = word.encode("utf-8"), text.encode("utf-8")
                    key = (folded(raw), raw)
                    if not raw or b"\0" in raw:
                        raise StarDictError(f"record {n} has no word that the format can hold")
                    if before is not None and key < before:
                        raise StarDictError(f"record {word} is out of order")
                    if offset + len(data) > LARGEST_PAYLOAD or place > LARGEST_INDEX:
                        raise StarDictError("a container holds 4 GB; write more of them")
                    if n % STRIDE == 0:
                        starts.append(place)
                    index.write(raw + b"\0" + struct.pack(">II", offset, len(data)))
                    payload.write(data)
                    n, place, offset, before = n + 1, place + len(raw) + 9, offset + len(data), key
                    first, last = word if first is None else first, word
        with system.open_output_stream(f"{path}/lexicon.idx.oft") as f:
            f.write(CACHE_HEADER + bytes(CACHE_OPAQUE) + struct.pack(f"<{len(starts) + 1}I", *starts, place))
        head = {"version": "3.0.0", "bookname": self.name, "wordcount": n, "idxfilesize": place, "sametypesequence": "m"}
        with system.open_output_stream(f"{path}/lexicon.ifo") as f:
            f.write("".join(f"{x}\n" for x in (HEADER, *(f"{k}={v}" for k, v in head.items()))).encode())
        return Written(own, first or "", last or "", n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = files.opened(self.folder)
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: order(m.first))
        for a, b in zip(parts, parts[1:], strict=False):
            if order(a.last) > order(b.first):
                self.abort(messages)
                raise StarDictError("containers overlap; deal the rows by range of the format's order")
        if not self.overwrite and files.exists(system, f"{root}/{MANIFEST}"):
            self.abort(messages)
            raise StarDictError(f"{self.folder} holds containers already")
        files.put(system, f"{root}/{MANIFEST}", json.dumps({"containers": [vars(m) for m in parts]}).encode())
        for name in files.listed(system, root):  # what earlier writes left
            if name.startswith("write-") and name != self.write_id:
                system.delete_dir(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = files.opened(self.folder)
        if files.exists(system, f"{root}/{self.write_id}"):
            system.delete_dir(f"{root}/{self.write_id}")


class StarDictSource(DataSource):
    """Reading options: mode (FAILFAST or PERMISSIVE, which reports bad records in `error`), rowsPerPartition, and pushdown,
    which `for_lookups` sets. Writing (see `stardict_writer.write_containers`): bookname."""

    @classmethod
    def name(cls) -> str:
        return "stardict"

    def schema(self) -> str:
        return "ordinal int, headword string, offset bigint, size int, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_LookupReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool):
        return ContainerWriter(self.options, overwrite)


def for_lookups(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The containers' records, with conditions on the headword pushed into the source. The index must be in the format's
    order, as all written here are; Spark is told to hand conditions to Python sources."""
    spark.dataSource.register(StarDictSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("stardict").options(**options).option("pushdown", "true").load(folder)
