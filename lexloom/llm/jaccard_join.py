"""Jaccard join of word n-gram sets by chosen paths.

Texts with one and the same set form an exact class, which one representative stands for. Each run hashes sets into
nodes: a set is sent to the node of every shingle whose hash under the run lies below 1 / (threshold * size), so two
similar sets meet with a known chance. A node with many sets is split the same way, again and again until it is small:
its sets are sent on by the entries of their min-hash sketches that hash low under the node, a little more generously,
so that a pair at the threshold keeps its chance at any depth. Nodes whose sets are alike on average (groups of near
copies) gain nothing from splitting and are compared as they are.

What shares a node in the end is compared by brute force: first by sketches, then, for those that may be similar, by
whole sets. Large nodes are compared in pairs of blocks, so no task holds more than two blocks and nothing is left out.
Runs repeat until the target recall. A pair that meets in several nodes counts in the least of them only, so links are
counted without a list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, encode, hash_words, let_go, mix, owners, per_row, slices, split_words, table, text_of, windows
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
#: Nodes of more sets than this are split, unless the sets' mean similarity is at least this.
SPLIT, ALIKE = 256, 0.45
#: Mean similarity is measured on every so many-th entry of the sketch.
PROBE = 2
#: How many shared entries a pair at the threshold sends on from a node, on average.
SPREAD = 1.6
#: Nodes are compared in blocks of about so many sets or shingles.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
BINS, EMPTY = 64, 0xFFFF
#: The test of sketches allows for so many standard deviations, which loses so many of the pairs at the threshold at most.
DEVIATIONS, SKETCH_LOSS = 5, 2e-5


def chance() -> float:
    """The least chance that a pair at the threshold meets in a run, however deep its nodes are split.

    The entries it shares and both choose are Poisson, with mean 1 at the first level and SPREAD below. With the chance
    x at the level after, a level has 1 - exp(-mean * x), which falls with depth to the fixed point.
    """
    x = 1.0
    for _ in range(200):
        x = 1 - math.exp(-SPREAD * x)
    return 1 - math.exp(-x)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has met, and is not lost by the sketches, with this chance."""
    return math.ceil(math.log(1 - recall - SKETCH_LOSS) / math.log(1 - chance()))


def shingle_sets(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's k-word windows, and their number. A text of fewer words has its whole
    word sequence as the only shingle; one without words has none."""
    words, counts = split_words(text)
    codes, distinct = encode(words)
    h = hash_words(distinct)[codes]
    found, n = windows(h, counts, k)
    row = owners(n)
    first = np.cumsum(counts) - counts
    for size in range(1, k):
        rows = np.flatnonzero(counts == size)
        whole = np.full(len(rows), size, dtype=np.uint64)
        for i in range(size):
            whole = mix(whole) * np.uint64(0x9E3779B97F4A7C15) + h[first[rows] + i]
        found, row = np.concatenate([found, mix(whole)]), np.concatenate([row, rows])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.bincount(row[new], minlength=len(counts)).astype(np.int64)


def set_keys(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set, as signed 64 bits."""
    return mix(per_row(mix(found ^ np.uint64(0x2545F4914F6CDD1D)), n) + n.astype(np.uint64)).view(np.int64)


def sketches(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One-permutation minima: of each 64th of the hash range, 16 bits of the least hash."""
    out = np.full((len(n), BINS), EMPTY, dtype=np.uint16)
    row, part = owners(n), (found >> np.uint64(58)).astype(np.int64)
    new = np.ones(len(found), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    out[row[new], part[new]] = np.minimum((found[new] >> np.uint64(42)) & np.uint64(0xFFFF), EMPTY - 1).astype(np.uint16)
    return out


def bits(of: np.ndarray) -> pa.Array:
    """Rows of 64 truth values as signed 64-bit numbers, the first value lowest."""
    return pa.array(np.packbits(of, axis=1, bitorder="little").view("<i8").ravel().astype(np.int64))


def chosen(found: np.ndarray, n: np.ndarray, row: np.ndarray, seed: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below each seed (one a set): places in found's rows, and the nodes' hashes."""
    limit = np.minimum(2.0**64 / np.maximum(threshold * n, 1), 2.0**64 - 2048).astype(np.uint64)
    h = mix(found ^ seed[row])
    at = np.flatnonzero(h < limit[row])
    return row[at], mix(h[at] + np.uint64(0x9E3779B97F4A7C15))


def paths(found: np.ndarray, n: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of all runs, as (row, node)."""
    row = owners(n)
    seeds = [np.full(len(n), mix(np.array([run + 1], dtype=np.uint64))[0]) for run in range(runs)]
    return tuple(map(np.concatenate, zip(*(chosen(found, n, row, seed, threshold) for seed in seeds), strict=True)))


def _split(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The nodes below each node for each of its sets, by the entries of the set's sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, BINS)
        row, part = np.nonzero(sketch != EMPTY)
        entries = mix((part.astype(np.uint64) << np.uint64(16)) | sketch[row, part])
        n = np.bincount(row, minlength=len(sketch))
        of, node = chosen(entries, n, row, np.asarray(batch.column("node")).view(np.uint64), threshold / SPREAD)
        taken = batch.take(pa.array(of))
        names = ["key", "size", "node", "signs", "full", "sketch"]
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)) if n == "node" else taken.column(n) for n in names], names)


def _signatures(batches: Iterator[pa.RecordBatch], k: int, runs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        found, n = shingle_sets(text_of(batch), k)
        row, node = paths(found, n, runs, threshold)
        order = np.argsort(row, kind="stable")
        at = np.searchsorted(row[order], np.arange(len(n) + 1)).astype(np.int32)
        nodes = pa.ListArray.from_arrays(at, pa.array(node[order].view(np.int64)))
        sketch = sketches(found, n)
        cols = [batch.column("doc_id"), batch.column("id"), batch.column("hash"), pa.array(set_keys(found, n)), pa.array(n), nodes, bits(sketch & 1), bits(sketch != EMPTY), pa.array([x.tobytes() for x in sketch], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "id", "hash", "key", "size", "nodes", "signs", "full", "sketch"])


def met_before(ids: list[np.ndarray], node: int) -> np.ndarray:
    """Whether two members share a node less than this one."""
    flat = np.concatenate(ids)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    less = flat < node
    known, code, times = np.unique(flat[less], return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    out = np.zeros((len(ids), len(ids)), dtype=bool)
    width, code, row = int(shared.sum()), code, row[less]
    keep = shared[code]
    code, row = place[code[keep]], row[keep]
    for a in range(0, width, 4096):
        m = np.zeros((len(ids), min(4096, width - a)), dtype=np.float32)
        at = (code >= a) & (code < a + 4096)
        m[row[at], code[at] - a] = 1
        out |= (m @ m.T) > 0
    return out


def may_be_similar(sketch: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sketches agree as similar sets' do, give or take some standard deviations."""
    out = np.zeros((len(sketch), len(sketch)), dtype=bool)
    full = sketch != EMPTY
    for i in range(len(sketch)):
        either = (full[i] | full[i + 1 :]).sum(axis=1)
        same = ((sketch[i] == sketch[i + 1 :]) & full[i]).sum(axis=1)
        out[i, i + 1 :] = same >= threshold * either - DEVIATIONS * np.sqrt(threshold * (1 - threshold) * either)
    return out | out.T


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Pairs of sets whose Jaccard similarity is the threshold or more, exactly."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    known, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    place = np.cumsum(times > 1) - 1
    code, row = place[code[keep]], row[keep]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for a in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(code, [a, a + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[row[lo:hi], code[lo:hi] - a] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    out = both >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, dict]]:
    """node, i, j and the members' columns of each group."""
    for batch in batches:
        node, i, j = (batch.column(c).to_pylist() for c in ("node", "i", "j"))
        members = batch.column("members")
        for g in range(batch.num_rows):
            s = members[g].values
            yield node[g], i[g], j[g], dict(zip([f.name for f in s.type], s.flatten(), strict=True))


def _ids(col: pa.Array) -> list[np.ndarray]:
    at = np.asarray(col.offsets)
    flat = np.asarray(col.values)
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _pairs_here(block: np.ndarray, i: int, j: int) -> np.ndarray:
    """The pairs this group answers for: of one block with another, or within one."""
    return (block[:, None] != block[None, :]) if i != j else np.ones((len(block), len(block)), dtype=bool)


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32())])
    out: list[tuple] = []
    for node, i, j, m in _groups(batches):
        sketch = np.frombuffer(b"".join(m["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, BINS)
        here = may_be_similar(sketch, threshold)
        if i != j:
            here &= _pairs_here(np.asarray(m["block"]), i, j)
        if here.any():
            here &= ~met_before(_ids(m["ids"]), node)
            key, block = np.asarray(m["key"]), np.asarray(m["block"])
            out += [(int(key[x]), node, i, j, int(block[x])) for x in np.flatnonzero(here.any(axis=1))]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)


def _with_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each group that a set is needed in."""
    for batch in slices(batches, "text", 256 << 10):
        found, n = shingle_sets(text_of(batch), k)
        right = set_keys(found, n) == np.asarray(batch.column("key"))  # hashes may collide
        start = np.cumsum(n) - n
        groups = batch.column("groups")
        at = np.asarray(groups.offsets)
        which = np.repeat(np.arange(batch.num_rows), np.diff(at))
        rows = pa.array(which[right[which]])
        inner = groups.values.slice(at[0], at[-1] - at[0]).filter(pa.array(right[which]))
        flat = dict(zip([f.name for f in inner.type], inner.flatten(), strict=True))
        blobs = pa.array([found[s : s + c].tobytes() for s, c in zip(start, n, strict=True)], pa.binary())
        for a in range(0, len(rows), 512):
            r = rows.slice(a, 512)
            cols = [*(flat[c].slice(a, 512) for c in ("node", "i", "j", "block")), *(batch.column(c).take(r) for c in ("key", "copies", "ids")), blobs.take(r)]
            yield pa.RecordBatch.from_arrays(cols, ["node", "i", "j", "block", "key", "copies", "ids", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each member with links in the group: the rows it is linked to, and the least key of its component here."""
    for node, i, j, m in _groups(batches):
        _, one = np.unique(np.asarray(m["key"]), return_index=True)
        key = np.asarray(m["key"])[one]
        sets = [np.frombuffer(m["shingles"][int(x)].as_py(), dtype=np.uint64) for x in one]
        ids = _ids(m["ids"])
        links = similar(sets, threshold) & _pairs_here(np.asarray(m["block"])[one], i, j)
        if not links.any():
            continue
        links &= ~met_before([ids[x] for x in one], node)
        weight = links @ np.asarray(m["copies"])[one].astype(np.int64)
        root = np.arange(len(key))
        while True:  # keys are sorted: the least place is the least key
            least = np.minimum(root, np.where(links, root[None, :], len(key)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        at = np.flatnonzero(links.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(weight[at]), pa.array(key[root[at]])], ["key", "weight", "root"])


def unlike(rows: DataFrame) -> DataFrame:
    """The nodes whose sets have a mean similarity below ALIKE, and their numbers of sets, from (node, signs, full).

    Similarity is the share of pairs of sets that agree in an entry of the sketch, or (sum of c * c - n) / (n * n - n)
    with c sets for each value the entry has. If every value has a sign at random (here its lowest bit), the square of
    the sum of all signs is the sum of c * c on average; the mean over many entries is close to it.
    """
    places = range(0, BINS, PROBE)
    has = [F.getbit("full", F.lit(b)).cast("long") for b in places]
    sign = [h * (2 * F.getbit("signs", F.lit(b)).cast("long") - 1) for b, h in zip(places, has, strict=True)]
    sums = rows.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(h).alias(f"n{b}") for b, h in zip(places, has, strict=True)], *[F.sum(s).alias(f"s{b}") for b, s in zip(places, sign, strict=True)])
    n, s = ([F.col(f"{c}{b}").cast("double") for b in places] for c in "ns")
    agree = sum(F.when(x > 1, (y * y - x) / (x * x - x)).otherwise(0.0) for x, y in zip(n, s, strict=True))
    known = sum((x > 1).cast("int") for x in n)
    return sums.filter(F.coalesce(agree / F.nullif(known, F.lit(0)), F.lit(0.0)) < ALIKE).select("node", "n")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copies, id, hash, class_key, class_hash for every row of docs (doc_id, text).

    class_id is the least doc_id of the component of documents linked by a similarity of `threshold` or more, n_links
    the number of other rows linked to this one, copies the number of rows with exactly its set, itself included.
    Texts without words (null, empty) have no links and stand alone, copies 1. Repeated rows are copies of each other.
    Rows with a null doc_id take part; a class of such rows alone has a null class_id. Ids may be of any type with an
    order. Very long texts are taken whole. A similarity of exactly the threshold is a link. Other columns of docs are
    ignored, whatever their names. id (the doc_id as text, '' for null) and hash (of the text) name a row's content,
    class_key and class_hash the row that stands for its class, so one row of a class can be kept without ids, too.
    """
    runs = runs_for(recall)
    text = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"), "text")
    signed = durable(
        text.mapInArrow(
            lambda it: _signatures(it, shingle, runs, threshold),
            f"doc_id {dict(docs.dtypes)['doc_id']}, id string, hash long, key long, size long, nodes array<long>, signs long, full long, sketch binary",
        )
    )
    # One row a distinct set, with a row that has it; copies meet in partial aggregates, so a large class is no large group.
    sets = durable(
        signed.filter("size > 0")
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "id", "hash")).alias("rep"), F.first(F.struct("size", "nodes", "signs", "full", "sketch")).alias("s"))
        .select("key", "copies", "rep", "rep.id", "rep.hash", "s.*")
    )
    # Level by level: small nodes, and those of sets that are alike, are leaves; the others are split.
    columns = ["key", "size", "node", "signs", "full", "sketch"]
    level = sets.withColumn("node", F.explode("nodes")).select(columns)
    leaves = crowd = None
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    while True:
        counts = durable(level.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1"))
        large = counts.filter(F.col("n") > SPLIT).select("node")
        wide = durable(unlike(level.join(large, "node", "left_semi")))
        now = wide.agg(F.sum("n")).first()[0] or 0
        # Sets that splitting no longer thins out are alike after all; they are compared as they are.
        done = now == 0 or (crowd is not None and now > 0.7 * crowd)
        crowd = now
        own = counts if done else counts.join(wide, "node", "left_anti")
        here = level.join(own, "node").select("key", "node", blocks)
        leaves = here if leaves is None else leaves.unionByName(here)
        if done:
            break
        inner = level.join(wide, "node", "left_semi").select(columns)
        level = durable(inner.mapInArrow(lambda it: _split(it, threshold), "key long, size long, node long, signs long, full long, sketch binary"))
        let_go(docs.sparkSession)
    leaves = leaves.groupBy("key").agg(F.collect_list(F.struct("node", "blocks")).alias("leaves"))
    placed = durable(leaves.join(sets.select("key", "copies", "id", "hash", "sketch"), "key").withColumn("ids", F.col("leaves.node")))
    del level, leaves, counts, large, wide, own, here
    let_go(docs.sparkSession)
    rows = (
        placed.select("key", "sketch", "ids", F.explode("leaves").alias("leaf"))
        .select("key", "sketch", "ids", "leaf.*", F.pmod(F.xxhash64("key"), "leaf.blocks").cast("int").alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "sketch", "ids")
    )
    need = (
        rows.groupBy("node", "i", "j")
        .agg(F.collect_list(F.struct("key", "block", "sketch", "ids")).alias("members"))
        .mapInArrow(lambda it: _candidates(it, threshold), "key long, node long, i int, j int, block int")
        .groupBy("key")
        .agg(F.collect_list(F.struct("node", "i", "j", "block")).alias("groups"))
        .join(placed.select("key", "copies", "id", "hash", "ids"), "key")
    )
    # Rows that repeat an id and its text would each bring the set again.
    if not signed.groupBy("id", "hash").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        text = text.dropDuplicates(["id", "hash"])
    linked = durable(
        need.join(text.drop("doc_id"), ["id", "hash"])
        .select("key", "copies", "ids", "groups", "text")
        .mapInArrow(lambda it: _with_sets(it, shingle), "node long, i int, j int, block int, key long, copies long, ids array<long>, shingles binary")
        .groupBy("node", "i", "j")
        .agg(F.collect_list(F.struct("key", "copies", "block", "ids", "shingles")).alias("members"))
        .mapInArrow(lambda it: _verify(it, threshold), "key long, weight long, root long")
    )
    let_go(docs.sparkSession)
    weights = linked.groupBy("key").agg(F.sum("weight").alias("weight"))
    label = components(linked.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    least = label.join(sets.select("key", "rep"), "key").groupBy("label").agg(F.min("rep").alias("first"))
    # Kept, so that the last join is one of two plain sides, whose large classes adaptive execution can split.
    first = F.coalesce("first", "rep")
    known = durable(
        sets.select("key", "rep", "copies")
        .join(weights, "key", "left")
        .join(label.join(least, "label").select("key", "first"), "key", "left")
        .select("key", first.doc_id.alias("class_id"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), "copies", first.id.alias("class_key"), first.hash.alias("class_hash"))
    )
    out = ["doc_id", "class_id", "n_links", "copies", "id", "hash", "class_key", "class_hash"]
    alone = signed.filter("size = 0").select("*", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), F.col("id").alias("class_key"), F.col("hash").alias("class_hash"))
    return signed.filter("size > 0").select("doc_id", "id", "hash", "key").join(known, "key").select(out).unionByName(alone.select(out))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")
