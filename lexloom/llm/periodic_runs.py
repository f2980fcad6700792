"""Runs of repeated words: maximal periodic stretches of a word sequence.

A run has a least period q, is at least twice as long (and at least `least` words), and no neighbouring word extends it.
The method: a suffix automaton of the words, whose states stand for sets of end positions; going from long states to
short ones, a state's ordered set of ends is merged into that of its suffix link, the smaller into the larger. An end
that comes in between two others shows two new distances; a distance d that is no greater than the length of the state
seeds a square of period d, as the words before both ends agree over d words and more. A seed is extended to both sides as
far as the period holds. Every run is found: its last word and the word one period earlier meet in a state at least as
long as the period, and no end lies between them there, or the period would not be the least.

Before the automaton, words that no run can hold are left out, exactly: all words of a run lie in stretches of half of
`least` words that occur twice in it. What is left falls into segments, which are judged again by themselves.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import encode, mix, owners, table, windows

#: Words that a run has at least.
LEAST = 12
#: Words that are worked on at a time; a longer row is taken alone and whole.
WORDS = 1 << 20
#: Ends in one block of an ordered set.
BLOCK = 1024
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Ends:
    """An ordered set of end positions, in blocks, so that adding one moves few others."""

    def __init__(self, end: int) -> None:
        self.blocks, self.last, self.size = [[end]], [end], 1

    def add(self, end: int) -> tuple[int | None, int | None]:
        """Adds an end that isn't there; returns its neighbours."""
        at = min(bisect_left(self.last, end), len(self.last) - 1)
        block = self.blocks[at]
        i = bisect_left(block, end)
        before = block[i - 1] if i else self.last[at - 1] if at else None
        after = block[i] if i < len(block) else self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None
        block.insert(i, end)
        self.size += 1
        self.last[at] = block[-1]
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.last[at : at + 1] = [block[BLOCK - 1], block[-1]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end (-1 for copies) of every state of the suffix automaton; state 0 is the empty one."""
    length, link, end, to = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(codes):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 < length[q]:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                to.append(to[q].copy())
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return length, link, end


def extend(codes: np.ndarray, period: int, start: int, stop: int) -> tuple[int, int]:
    """The longest stretch around [start, stop), which has the period, that has it, too."""
    n = 64
    while start:
        n = min(n, start)
        same = codes[start - n : start] == codes[start - n + period : start + period]
        if not same.all():
            start -= n - 1 - int(np.flatnonzero(~same)[-1])
            break
        start, n = start - n, 2 * n
    n = 64
    while stop < len(codes):
        n = min(n, len(codes) - stop)
        same = codes[stop : stop + n] == codes[stop - period : stop + n - period]
        if not same.all():
            stop += int(np.flatnonzero(~same)[0])
            break
        stop, n = stop + n, 2 * n
    return start, stop


def is_least(codes: np.ndarray, period: int, start: int, stop: int) -> bool:
    """Whether a stretch of at least two periods has no smaller one; a smaller one would divide the period."""
    rest, p, primes = period, 2, []
    while p * p <= rest:
        if rest % p == 0:
            primes.append(p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        primes.append(rest)
    return not any(np.array_equal(codes[start : stop - period // p], codes[start + period // p : stop]) for p in primes)


def runs_of(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one sequence, by start and period."""
    length, link, end = automaton(codes.tolist())
    half = (least + 1) // 2
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    known: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and stops of stretches, in order
    found = []

    def seed(period: int, stop: int) -> None:
        starts, stops = known.setdefault(period, ([], []))
        at = bisect_right(starts, stop - 2 * period)
        if at and stops[at - 1] >= stop:
            return
        start, stop = extend(codes, period, stop - 2 * period, stop)
        at = bisect_left(starts, start)
        starts.insert(at, start)
        stops.insert(at, stop)
        if stop - start >= least and is_least(codes, period, start, stop):
            found.append((start, stop - start, period))

    # A run's two ends meet in a state of half the run's words at least, so shorter states need no set.
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        mine, up = ends[state], link[state]
        ends[state] = None
        reach = length[up]
        if reach < half:
            continue
        others = ends[up]
        if others is None:
            ends[up] = mine
            continue
        if others.size < mine.size:
            mine, others = others, mine
        for e in mine:
            before, after = others.add(e)
            if before is not None and e - before <= reach:
                seed(e - before, e + 1)
            if after is not None and after - e <= reach:
                seed(after - e, after + 1)
        ends[up] = others
    return sorted(found, key=lambda r: (r[0], r[2]))


def segments(codes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the parts of rows, laid end to end, that may hold runs: every word lies in a window of half of
    `least` words that occurs twice in its part. Judged by hashes, of which chance agreements only keep more."""
    half = (least + 1) // 2
    place = np.arange(len(codes))
    part = owners(counts)
    while len(place):
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])))
        h, n = windows(codes[place], sizes, half)
        own = np.repeat(np.arange(len(n)), n)
        h = mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        # A window's place among the words: windows leave out the last half - 1 places of each part that is long enough.
        first = np.cumsum(sizes) - sizes
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        at = at[twice]
        cover = np.bincount(at, minlength=len(place) + half)[: len(place) + half] - np.bincount(at + half, minlength=len(place) + half)[: len(place) + half]
        kept = np.cumsum(cover)[: len(place)] > 0
        was = len(place)
        place, part = place[kept], part[kept]
        if len(place):
            new = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(part) != 0)])
            part = np.cumsum(new)
            long_enough = np.bincount(part)[part] >= least
            place, part = place[long_enough], part[long_enough]
        if len(place) == was:
            break
    if not len(place):
        return place, place
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return place[first], np.diff(np.concatenate([first, [len(place)]]))


def find(words: pa.ListArray, least: int = LEAST) -> tuple[pa.Array, pa.Array]:
    """For lists of words: each list's runs, and its words without repeats, joined by blanks. A word is a repeat if a run
    holds it after the run's first period. A null list counts as empty; a null word is a word of its own and joins as ''."""
    flat = pc.fill_null(pa.concat_arrays([words.flatten(), words.flatten().slice(0, 0)]), "")
    nulls = np.asarray(pc.is_null(words.flatten()))
    counts = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
    codes, distinct = encode(flat)
    codes = np.where(nulls, len(distinct), codes)
    first = np.cumsum(counts) - counts
    row, start, length, period = [], [], [], []
    for at, n in zip(*(x.tolist() for x in segments(codes, counts, least)), strict=True):
        of = int(np.searchsorted(first + counts, at, side="right"))
        for s, size, q in runs_of(codes[at : at + n], least):
            row.append(of)
            start.append(at + s - int(first[of]))
            length.append(size)
            period.append(q)
    row, start, length, period = (np.array(x, dtype=np.int64) for x in (row, start, length, period))
    order = np.lexsort((period, start, row))
    row, start, length, period = row[order], start[order], length[order], period[order]
    begin = first[row] + start
    repeats = np.cumsum(np.bincount(begin + period, minlength=len(codes) + 1) - np.bincount(begin + length, minlength=len(codes) + 1))[: len(codes)] > 0
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    each = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    left = np.bincount(owners(counts)[~repeats], minlength=len(counts))
    kept = pa.LargeListArray.from_arrays(offsets(left).cast(pa.int64()), flat.filter(pa.array(~repeats)).cast(pa.large_string()))
    return pa.ListArray.from_arrays(offsets(np.bincount(row, minlength=len(counts))), each), pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())


def periodic_runs(rows: DataFrame, words: str = "words", least: int = LEAST) -> DataFrame:
    """rows with `runs` (start, length and period in words, by start and period) and `collapsed`, the words without
    repeats, for each row's array of words.

    A null or empty array has no runs and collapses to ''; a null word is unlike every other but null. A row is one task's
    work whatever its size; the automaton sees only the parts that repeat within themselves. Rows that agree have the same
    runs; columns of rows that are named as the added ones are replaced, others stay; a table without rows gives one
    without rows.
    """
    kept = rows.select([F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("runs", "collapsed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(words)), 0)).astype(np.int64)
            part = (np.cumsum(size) - size) // WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    some = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*some.columns, *find(some.column(words), least)], [*some.schema.names, "runs", "collapsed"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(f"runs {RUNS}, collapsed string").fields]))


def planted(words: Column, doc_id: Column) -> Column:
    """The contract's words: in documents whose id's crc32 h is divisible by 10, the words from number a = g % n on repeat
    the p = 1 + (n - a) / (3 + g % 8) words that stand there, with g = h / 10. A null id changes nothing."""
    h, n = F.crc32(doc_id.cast("string")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), F.lit(1), n)).otherwise(words)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    found = periodic_runs(docs.select("doc_id", split.alias("words")).select("doc_id", planted(F.col("words"), F.col("doc_id")).alias("words")))
    # The greatest length first, then the smallest start and period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.least")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.least") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
