"""An interpolated modified Kneser-Ney model of any order from 2, counted in Spark and looked up in memory-mapped arrays.

Numbers: a first pass counts the words and numbers them, frequent ones first, so that what is sent of an n-gram are
small numbers in order instead of words' hashes. The numbers lie in arrays of their own that every task maps.

Counting: each task merges its n-grams and sends them, packed, to shards by a hash, so that no word or context, however
frequent, has a task of its own. A shard adds up its counts, writes them as a hashed table to the shared folder, and
passes on what it knows of the n-grams one word shorter (occurrences, left neighbours, right neighbours), which the next
exchange adds up in turn, down to single words. What a context at the highest order has of n-grams seen once is not
sent: it is what is left of its occurrences. Only paths and a few totals reach the driver.

Scoring: each worker maps the tables into memory and looks up a slice's distinct n-grams. An entry holds 40 bits of a
key beyond those of its shard and place, and one byte for its counts; rows of counts that are rare lie apart. The arrays
hold counts; discounts and interpolation are applied at lookup. With u the words between (none for pairs):

    p(w | vu) = max(a(vuw) - D(a), 0) / a(vu.) + gamma(vu) p(w | u)
    p(w)      = max(n(.w) - D'(n), 0) / n(..) + gamma' / (types + 1)

where a is the count at the highest order, and below it the number of distinct left neighbours, n; n-grams that start
with a begin mark have none, and keep their counts. The last term also covers unknown words. A text is its lower-cased
words between begin marks and an end mark; the end is predicted, the begin is not.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode, hash_words, id_bucket, mix, per_row, shared_path, slices, split_words, table, text_of

#: Numbers of the marks, of the first word, and of words that the model doesn't know.
BEGIN, END, FIRST, UNKNOWN = np.uint64(0), np.uint64(1), 2, np.uint64((1 << 64) - 1)
#: Tokens merged in a task before they are sent on, and tokens counted for each shard.
MERGE = 1 << 21
SHARD_TOKENS = 3_000_000
#: Bits of a key in an entry, entries of a place in a table at most on average, and the code of rare counts.
LOW, PLACE, RARE = 40, 6, 255
#: Columns that are added up below the highest order: occurrences, left neighbours, occurrences as context, and right
#: neighbours seen once, twice, and more often.
STATS = 6
#: The order of the query's model.
ORDER = 3


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def gram(*words: np.ndarray) -> np.ndarray:
    """The key of n-grams. From three words on its leading bits are those of the context and two of the last word, so
    that a shard has most of what it knows of a context together, and a context has four places at least."""
    key = mix(words[0] + np.uint64(1))
    for w in words[1:-1]:
        key = pair(key, w)
    if len(words) < 3:
        return pair(key, words[1]) if len(words) == 2 else key
    low = np.uint64((1 << 40) - 1)
    top = (key >> np.uint64(42)) << np.uint64(42)
    return top | (mix(words[-1]) >> np.uint64(62) << np.uint64(40)) | (pair(key, words[-1]) & low)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """By the leading bits, so the shards in order hold the hashes in order."""
    return ((key >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def tokens(text: pa.Array, number: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens, an end after each text's words, and the number of tokens of each text."""
    words, counts = split_words(pc.ascii_lower(text))
    codes, distinct = encode(words)
    n = counts + 1
    out = np.empty(int(n.sum()), dtype=np.uint64)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[ends], out[inner] = END, number(hash_words(distinct))[codes]
    return out, n


def before(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token; the begin mark at the start of a text."""
    v = np.concatenate([[BEGIN], w[:-1]]) if len(w) else w
    v[np.cumsum(n) - n] = BEGIN
    return v


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, which compresses small numbers to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: memoryview, n: int, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T).view(dtype).reshape(n)


def pack(*columns: np.ndarray) -> bytes:
    """N-grams with counts, which are the last column: the distinct words of every side once, and places among them."""
    *sides, c = columns
    out = io.BytesIO()
    head = []
    parts = []
    for side in sides:
        known, at = np.unique(side, return_inverse=True)
        head.append(len(known))
        parts += [known.tobytes(), _planes(at.astype(np.uint32))]
    out.write(np.array([len(c), *head], dtype=np.int64).tobytes())
    for p in [*parts, _planes(c.astype(np.uint32))]:
        out.write(p)
    return pa.Codec("zstd", 1).compress(out.getvalue(), asbytes=True)


def unpack(data: bytes, size: int, order: int = 2) -> tuple[np.ndarray, ...]:
    raw = memoryview(pa.Codec("zstd").decompress(data, size, asbytes=True))
    at = 8 + 8 * order
    n, *lengths = np.frombuffer(raw[:at], dtype=np.int64).tolist()
    sides = []
    for k in lengths:
        known = np.frombuffer(raw[at : at + 8 * k], dtype=np.uint64)
        at += 8 * k
        sides.append(known[_unplanes(raw[at : at + 4 * n], n, np.uint32)])
        at += 4 * n
    return *sides, _unplanes(raw[at:], n, np.uint32).astype(np.int64)


def packed_size(*sizes: int) -> int:
    """Of the numbers of distinct words of every side, and of n-grams."""
    *words, n = sizes
    return 8 + 8 * len(words) + 8 * sum(words) + 4 * (len(words) + 1) * n


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """The bytes of the numbers by significance, as many as the largest has, and how many."""
    k = max((int(x.max()).bit_length() + 7) // 8, 1)
    return k, np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :k].T).tobytes()


def pack_numbers(sides: list[np.ndarray], stats: np.ndarray) -> tuple[bytes, int]:
    """N-grams of words' numbers with columns of counts, and the size unpacked. They are put in order, and the first of
    the order's numbers are sent as differences."""
    lead = max(len(sides) - 2, 0)
    order = np.lexsort([*sides[:lead:-1], *sides[:lead], sides[lead]])
    sides, stats = [x[order] for x in sides], stats[order]
    columns = [np.diff(x, prepend=np.uint64(0)) if i == lead else x for i, x in enumerate(sides)]
    parts = [_narrow(x) for x in [*columns, *stats.T]]
    raw = np.array([len(stats), *(k for k, _ in parts)], dtype=np.int64).tobytes() + b"".join(x for _, x in parts)
    return pa.Codec("zstd", 1).compress(raw, asbytes=True), len(raw)


def unpack_numbers(data: bytes, size: int, order: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True), dtype=np.uint8)
    at = 8 * (1 + order + width)
    n, *bytes_of = raw[:at].view(np.int64).tolist()
    columns = []
    for k in bytes_of:
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :k] = raw[at : at + k * n].reshape(k, n).T
        columns.append(wide.view("<u8").reshape(n))
        at += k * n
    lead = max(order - 2, 0)
    columns[lead] = np.cumsum(columns[lead], dtype=np.uint64)
    return columns[:order], np.stack(columns[order:], axis=1).astype(np.int64)


def merge(keys: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of the columns (one row a key), and where each key first stood."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(columns[order], first, axis=0) if len(keys) else columns[:0]
    return keys[first], sums, order[first]


def store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of the shared folder, and the path in it. Hadoop's names of S3 are Arrow's s3."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", root))


def save(root: str, kind: str, shard: int, arrays: list[np.ndarray]) -> str:
    """Writes the arrays under names of this attempt's own; only paths of attempts that succeed are used."""
    fs, base = store(root)
    fs.create_dir(base, recursive=True)
    name = f"{kind}-{shard:06d}-{uuid.uuid4().hex}"
    for i, x in enumerate(arrays):
        with fs.open_output_stream(f"{base}/{name}-{i}.npy") as f:
            np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(x))
            f.write(np.ascontiguousarray(x).tobytes())
    return name


def load(root: str, name: str, count: int) -> list[np.ndarray]:
    """The arrays, mapped into memory; from a store without local files, copied to a file of the worker first."""
    fs, base = store(root)
    out = []
    for i in range(count):
        path = f"{base}/{name}-{i}.npy"
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            local = tempfile.NamedTemporaryFile(suffix=".npy", delete=False)
            with fs.open_input_stream(path) as f, local:
                while block := f.read(1 << 24):
                    local.write(block)
            out.append(np.load(local.name, mmap_mode="r"))
            os.unlink(local.name)  # the mapping stays
        else:
            out.append(np.load(path, mmap_mode="r"))
    return out


def hashed(key: np.ndarray, values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A table of distinct keys with a record each: entries by hash, where each place starts, the entries whose records
    are rare, and the distinct records, frequent ones first; and the order of the entries."""
    h = mix(key)
    order = np.argsort(h)
    h = h[order]
    bits = np.uint64(max((len(h) // PLACE).bit_length(), 1))
    start = np.searchsorted(h >> (np.uint64(64) - bits), np.arange((1 << int(bits)) + 1, dtype=np.uint64)).astype(np.uint32)
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.itemsize), len(values), [None, pa.py_buffer(values[order].tobytes())])
    codes, kinds = encode(flat)
    often = np.argsort(-np.bincount(codes, minlength=len(kinds)), kind="stable")
    rank = np.empty(len(kinds), dtype=np.int64)
    rank[often] = np.arange(len(kinds))
    code = rank[codes]
    low = h >> (np.uint64(64 - LOW) - bits)
    entries = np.empty(len(h), dtype=[("low", "<u4"), ("high", "u1"), ("code", "u1")])
    entries["low"], entries["high"], entries["code"] = low & np.uint64(0xFFFFFFFF), (low >> np.uint64(32)) & np.uint64(0xFF), np.minimum(code, RARE)
    at = np.flatnonzero(code >= RARE)
    rare = np.empty(len(at), dtype=[("at", "<u4"), ("kind", "<u4")])
    rare["at"], rare["kind"] = at, code[at]
    return [entries, start, rare, np.frombuffer(b"".join(kinds.to_pylist()), dtype=values.dtype)[often]], order


def places(key: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """The keys' entries in the table; -1 where absent."""
    entries, start = table[:2]
    h = mix(key)
    bits = np.uint64((len(start) - 1).bit_length() - 1)
    bucket = (h >> (np.uint64(64) - bits)).astype(np.int64)
    low = h >> (np.uint64(64 - LOW) - bits)
    low, high = low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8)
    at, end = start[bucket].astype(np.int64), start[bucket + 1].astype(np.int64)
    found = np.full(len(key), -1, dtype=np.int64)
    left = np.flatnonzero(at < end)
    known_low, known_high = entries["low"], entries["high"]
    at, end, low = at[left], end[left], low[left]
    while len(left):
        near = known_low[at] == low
        hit = np.flatnonzero(near)
        right = known_high[at[hit]] == high[left[hit]]
        near[hit] = right
        found[left[hit[right]]] = at[hit[right]]
        at += 1
        go = np.flatnonzero(~near & (at < end))
        left, at, end, low = left[go], at[go], end[go], low[go]
    return found


def values_at(at: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """The records of entries."""
    entries, _, rare, kinds = table[:4]
    kind = entries["code"][at].astype(np.int64)
    far = np.flatnonzero(kind == RARE)
    if len(far):
        kind[far] = rare["kind"][np.searchsorted(rare["at"], at[far].astype(np.uint32))]
    return kinds[kind]


@dataclass
class Words:
    """Where the words' numbers lie, by shard, and the number before the first of each frequency (a power of two)."""

    root: str
    shards: int
    names: list[str]
    base: list[list[int]]

    def numbers(self) -> Callable[[np.ndarray], np.ndarray]:
        """Maps the tables; what is returned maps distinct hashes of words to their numbers."""
        tables = [load(self.root, name, 5) if name else None for name in self.names]

        def number(hashes: np.ndarray) -> np.ndarray:
            out = np.full(len(hashes), UNKNOWN, dtype=np.uint64)
            order = np.argsort(hashes)
            cut = np.searchsorted(shard_of(hashes[order], self.shards), np.arange(self.shards + 1, dtype=np.uint64))
            for s, table in enumerate(tables):
                own = order[cut[s] : cut[s + 1]]
                if table and len(own):
                    at = places(hashes[own], table)
                    own, at = own[at >= 0], at[at >= 0]
                    out[own] = np.array(self.base[s], dtype=np.int64)[values_at(at, table)["f0"]] + table[4][at]
            return out

        return number


def number_words(docs: DataFrame, root: str, shards: int) -> Words:
    """Numbers the words of all texts by frequency, to the power of two; of equal ones, by hash."""

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, c, _ = merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
        cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1, dtype=np.uint64))
        for s in range(shards):
            a, b = cut[s], cut[s + 1]
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed_size(int(b - a), int(b - a))], pa.int64()), pa.array([pack(key[a:b], c[a:b])], pa.binary())], ["shard", "size", "data"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in slices(batches, "text", 4 << 20):
            codes, distinct = encode(split_words(pc.ascii_lower(text_of(batch)))[0])
            held.append((hash_words(distinct), np.bincount(codes, minlength=len(distinct))))
            n_held += len(distinct)
            if n_held >= MERGE:
                yield from send(held)
                held, n_held = [], 0
        if held:
            yield from send(held)

    def add(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [unpack(d, s, 1) for d, s in zip(group.column("data").to_pylist(), group.column("size").to_pylist(), strict=True)]
        key, c, _ = merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        power = np.frexp(c.astype(np.float64))[1]
        table, order = hashed(key, records([power]))
        power = power[order]
        by_power = np.argsort(power, kind="stable")
        sizes = np.bincount(power, minlength=64)
        nth = np.empty(len(power), dtype=np.uint32)
        nth[by_power] = np.arange(len(power)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.Table.from_arrays([pa.array([shard], pa.int32()), pa.array([save(root, "numbers", shard, [*table, nth])]), pa.array([sizes.tolist()], pa.list_(pa.int64()))], ["shard", "name", "sizes"])

    sent = docs.select("text").mapInArrow(words, "shard int, size long, data binary").repartitionById(shards, "shard")
    got = {r.shard: r for r in sent.groupBy("shard").applyInArrow(add, "shard int, name string, sizes array<long>").collect()}  # one row a shard
    sizes = np.array([got[s].sizes if s in got else [0] * 64 for s in range(shards)])
    ends = np.cumsum(sizes[:, ::-1].T.ravel()).reshape(64, shards).T[:, ::-1]
    return Words(root, shards, [got[s].name if s in got else "" for s in range(shards)], (FIRST + ends - sizes).tolist())


@dataclass
class Model:
    """Where the tables lie, by length of n-grams and shard, the words' numbers, and the totals."""

    root: str
    order: int
    words: Words
    #: Shards by length, from single words on.
    n_shards: list[int]
    n_tokens: int
    n_types: int
    grams: list[list[tuple[int, str]]] = field(default_factory=list)
    #: By length: n-grams that count once, twice, three and four times, and all of them.
    counts: list[list[int]] = field(default_factory=list)
    totals: list[int] = field(default_factory=list)
    #: Words with one, two, more left neighbours.
    left_classes: list[int] = field(default_factory=list)

    @property
    def shards(self) -> int:
        return self.n_shards[-1]


def discounts(n: list[int]) -> np.ndarray:
    """The three discounts from the counts of counts, at places 1 to 3; each lies in [0, its count]."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 1.0]
    return np.array([0.0, *(float(np.clip(x, 0.05, k + 0.95)) for k, x in enumerate(d))])


def records(columns: list[np.ndarray]) -> np.ndarray:
    """The columns as one array of records, each in the least type that holds it."""
    kinds = [np.min_scalar_type(int(x.max())) for x in columns]
    out = np.empty(len(columns[0]), dtype=[(f"f{i}", k) for i, k in enumerate(kinds)])
    for i, x in enumerate(columns):
        out[f"f{i}"] = x
    return out


def contexts(w: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """The tokens at each place of the n-grams that end in each token, the last of them the token itself."""
    sides = [w]
    for _ in range(order - 1):
        sides.insert(0, before(sides[0], n))
    return sides


def count(docs: DataFrame, order: int = 2) -> Model:
    """Counts all texts of docs (null: empty), very long ones whole, repeated rows each by itself. Of a table without rows
    the model knows no token. Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    root = shared_path(spark, "kneser-ney")
    # About one token in six bytes; more or fewer shards change only their size.
    total = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = 1 + int((total[0] or 0) / 6 + total[1]) * (order - 1) // SHARD_TOKENS
    n_shards = [1 + shards // 4, *[shards] * (order - 1)]
    known = number_words(docs, root, n_shards[0])

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sides = [np.concatenate(x) for x in zip(*held, strict=True)]
        key, c, at = merge(gram(*sides), np.ones(len(sides[0]), dtype=np.int64))
        sides = [x[at] for x in sides]
        cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1, dtype=np.uint64))
        for s in range(shards):
            a, b = cut[s], cut[s + 1]
            if b > a:
                x, size = pack_numbers([x[a:b] for x in sides], c[a:b, None])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([size], pa.int64()), pa.array([x], pa.binary())], ["shard", "size", "data"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        number = known.numbers()
        for batch in slices(batches, "text", 4 << 20):
            w, n = tokens(text_of(batch), number)
            held.append(contexts(w, n, order))
            n_held += len(w)
            if n_held >= MERGE:
                yield from send(held)
                held, n_held = [], 0
        if held:
            yield from send(held)

    def shorter(level: int, sides: list[np.ndarray], raw: np.ndarray, a: np.ndarray) -> Iterator[tuple]:
        """What n-grams tell of those one word shorter: of their ends, then of their contexts."""
        seen = np.flatnonzero(a > 0)
        sides, raw, a = [x[seen] for x in sides], raw[seen], a[seen]
        stats = np.zeros((len(a), STATS), dtype=np.int64)
        stats[:, 0], stats[:, 1] = raw, 1
        ends = sides[1:]
        key_e, stats_e, at_e = merge(gram(*ends), stats)
        stats[:, :2] = 0
        stats[:, 2] = a
        for j, hit in enumerate((a == 1, a == 2, a > 2)):
            stats[:, 3 + j] = hit
        heads = sides[:-1]
        if level == order:
            # What contexts have of n-grams seen once is the rest of their occurrences, but for those that end in a begin.
            some = np.flatnonzero((a > 1) | (heads[-1] == BEGIN))
            heads, stats = [x[some] for x in heads], stats[some]
        key_h, stats_h, at_h = merge(gram(*heads), stats)
        key, stats, at = merge(np.concatenate([key_e, key_h]), np.concatenate([stats_e, stats_h]))
        sides = [np.concatenate([e[at_e], h[at_h]])[at] for e, h in zip(ends, heads, strict=True)]
        n = n_shards[level - 2]
        cut = np.searchsorted(shard_of(key, n), np.arange(n + 1, dtype=np.uint64)).tolist()
        for s in range(n):
            x, y = cut[s], cut[s + 1]
            if y > x:
                data, size = pack_numbers([z[x:y] for z in sides], stats[x:y])
                yield s, "", [level - 1, size], data

    def result(rows: list[tuple]) -> pa.Table:
        kinds = (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "name", "totals", "data"])

    def described(level: int, shard: int, a: np.ndarray) -> list[int]:
        return [level, shard, *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 0).sum())]

    def add_top(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [unpack_numbers(d, s, order, 1) for d, s in zip(group.column("data").to_pylist(), group.column("size").to_pylist(), strict=True)]
        sides = [np.concatenate([p[0][i] for p in parts]) for i in range(order)]
        c = np.concatenate([p[1][:, 0] for p in parts])
        del parts
        key, c, at = merge(gram(*sides), c)
        sides = [x[at] for x in sides]
        name = save(root, f"grams{order}", shard, hashed(key, records([c]))[0])
        return result([(shard % n_shards[-2], name, described(order, shard, c), None), *shorter(order, sides, c, c)])

    def add(level: int):
        """Adds up the n-grams of a length below the highest; rows that describe longer ones pass."""

        def run(group: pa.Table) -> pa.Table:
            shard = group.column("shard")[0].as_py()
            rows, parts = [], []
            for name, totals, data in zip(*(group.column(c).to_pylist() for c in ("name", "totals", "data")), strict=True):
                if name:
                    rows.append((shard % n_shards[max(level - 2, 0)], name, totals, None))
                else:
                    parts.append(unpack_numbers(data, totals[1], level, STATS))
            if not parts:
                return result(rows)
            sides = [np.concatenate([p[0][i] for p in parts]) for i in range(level)]
            stats = np.concatenate([p[1] for p in parts])
            del parts
            key, stats, at = merge(gram(*sides), stats)
            sides = [x[at] for x in sides]
            if level == order - 1:
                inner = (sides[-1] != BEGIN) & (sides[-1] != END)
                stats[:, 3] = np.where(inner, stats[:, 0] - stats[:, 2], stats[:, 3])
                stats[:, 2] = np.where(inner, stats[:, 0], stats[:, 2])
            if level == 1:
                name = save(root, "words", shard, hashed(key, records([*stats.T]))[0])
                seen, left = stats[:, 0], stats[:, 1]
                return result([*rows, (shard, name, [*described(1, shard, left), int(seen.sum()), int((seen > 0).sum()), int((left > 2).sum())], None)])
            a = np.where(sides[0] == BEGIN, stats[:, 0], stats[:, 1])
            name = save(root, f"grams{level}", shard, hashed(key, records([a, *stats[:, 2:].T]))[0])
            return result([*rows, (shard % n_shards[level - 2], name, described(level, shard, a), None), *shorter(level, sides, stats[:, 0], a)])

        return run

    kind = "shard int, name string, totals array<long>, data binary"
    rows = docs.select("text").mapInArrow(grams, "shard int, size long, data binary").repartitionById(shards, "shard").groupBy("shard").applyInArrow(add_top, kind)
    for level in range(order - 1, 0, -1):
        rows = rows.repartitionById(n_shards[level - 1], "shard").groupBy("shard").applyInArrow(add(level), kind)
    manifest = rows.select("name", "totals").collect()  # one row a shard
    grams_of, counts, totals, words = [], [], [], np.zeros(8, dtype=np.int64)
    for level in range(1, order + 1):
        own = sorted((r.totals[1], r.name, r.totals[2:]) for r in manifest if r.totals[0] == level)
        sums = np.array([t for *_, t in own], dtype=np.int64).reshape(len(own), -1).sum(axis=0).tolist() if own else [0] * 8
        words = sums if level == 1 else words
        grams_of.append([x[:2] for x in own])
        counts.append(sums[:4])
        totals.append(sums[4])
    return Model(root, order, known, n_shards, words[5], words[6], grams_of, counts, totals, [words[0], words[1], words[7]])


def lookup(keys: np.ndarray, arrays: dict[int, list[np.ndarray]], shards: int, width: int) -> np.ndarray:
    """The values of the keys, zeros where absent."""
    out = np.zeros((len(keys), width), dtype=np.int64)
    shard = shard_of(keys, shards).astype(np.uint16 if shards <= 1 << 16 else np.uint64)  # short numbers are sorted by digits
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s, table in arrays.items():
        own = order[cut[s] : cut[s + 1]]
        if len(own):
            at = places(keys[own], table)
            hit = at >= 0
            own, got = own[hit], values_at(at[hit], table)
            for i, name in enumerate(got.dtype.names):
                out[own, i] = got[name]
    return out


def width(level: int, order: int) -> int:
    """Columns of the arrays: all, without occurrences and left neighbours but with the count, or the count alone."""
    return STATS if level == 1 else STATS - 1 if level < order else 1


def log_probabilities(w: np.ndarray, n: np.ndarray, model: Model, arrays: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of every token given those before, and its training count."""
    order = model.order
    sides = contexts(w, n, order)
    first = np.cumsum(n) - n

    def find(words: list[np.ndarray]) -> np.ndarray:
        level = len(words)
        return lookup(gram(*words), arrays[level - 1], model.n_shards[level - 1], width(level, order))

    distinct, back = np.unique(w, return_inverse=True)
    own = find([distinct])[back]
    seen, left = own[:, 0], own[:, 1]
    d = discounts(model.counts[0])
    total = max(model.totals[1], 1)
    rest = float(np.dot(d[1:], model.left_classes)) / total if model.totals[1] else 1.0
    p = np.maximum(left - d[np.minimum(left, 3)], 0) / total + rest / (model.n_types + 1)
    for level in range(2, order + 1):
        d = discounts(model.counts[level - 1])
        # A token's context is the n-gram that ends in the token before; a text's first token has begin marks alone.
        context = np.concatenate([own[:1], own[:-1]])[:, -4:]
        context[first] = find([np.full(1, BEGIN)] * (level - 1))[:, -4:]
        times = np.maximum(context[:, 0], 1)
        gamma = np.where(context[:, 0] > 0, context[:, 1:] @ d[1:] / times, 1.0)
        own = find(sides[order - level :])
        a = own[:, 0]
        p = np.maximum(a - d[np.minimum(a, 3)], 0) / times + gamma * p
    return np.log10(p), seen


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; a null text counts as empty, which is
    one token, the end. Without any training text every token has the same probability. Very long texts are scored whole;
    repeated rows have the same score; other columns are ignored, whatever their names; no rows give none."""
    given = vars(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**given)
        number = m.words.numbers()
        arrays = [{s: load(m.root, name, 4) for s, name in g} for g in m.grams]
        for batch in slices(batches, "text", 4 << 20):
            w, n = tokens(text_of(batch), number)
            logp, c = log_probabilities(w, n, m, arrays)
            base = np.log10((c + 0.5) / (m.n_tokens + 0.5 * (m.n_types + 1)))
            # Text by text, so that a document's sums don't depend on its neighbours.
            first = np.cumsum(n) - n
            out = [batch.column("doc_id"), pa.array(n), pa.array(per_row((c > 0).astype(np.int64), n)), pa.array(np.full(len(n), m.n_tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logp, first))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = count(docs.filter(id_bucket("doc_id", 5) != 1), ORDER)
    return score(docs, model).select("doc_id", (id_bucket("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
