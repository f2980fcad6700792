"""Many patterns in one pass over a text: an Aho-Corasick automaton, built once a task from patterns the driver holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of all patterns together: the automaton of so many takes some hundreds of MB in each Python worker.
MOST_CHARACTERS = 4_000_000


def checked(patterns: Sequence[str]) -> list[str]:
    """The distinct patterns in their order. Empty ones and too many are errors."""
    once = list(dict.fromkeys(patterns))
    if not all(once):
        raise ValueError("an empty pattern stands everywhere")
    if sum(map(len, once)) > MOST_CHARACTERS:
        raise ValueError(f"patterns may have {MOST_CHARACTERS} characters in all")
    return once


def automaton(patterns: Sequence[str]) -> ahocorasick.Automaton:
    """Finds the patterns by their numbers."""
    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        found.add_word(p, i)
    found.make_automaton()
    return found


def occurrence_counts(texts: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """token, n, entries for every pattern: occurrences without overlaps of one with itself, from the left, and texts with
    any. A task sends one row a pattern, whatever its texts; patterns that occur nowhere have zeros. Null texts have none."""
    known = checked(patterns)
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sizes = automaton(known) if known else None, [len(p) for p in known]
        n, entries = [0] * len(known), [0] * len(known)
        for batch in batches:
            for value in batch.column(0):
                value = value.as_py()
                if not value or find is None:
                    continue
                last: dict[int, int] = {}  # where a pattern may begin again
                for end, i in find.iter(value):
                    begin = end + 1 - sizes[i]
                    if i not in last:
                        entries[i] += 1
                    elif begin < last[i]:
                        continue
                    n[i] += 1
                    last[i] = end + 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(known)), pa.int32()), pa.array(n, pa.int64()), pa.array(entries, pa.int64())], ["i", "n", "entries"])

    counted = texts.select(F.col(f"`{text}`")).mapInArrow(count, "i int, n bigint, entries bigint")
    names = spark.createDataFrame([(i, p) for i, p in enumerate(known)], "i int, token string")
    summed = counted.groupBy("i").agg(F.sum("n").alias("n"), F.sum("entries").alias("entries"))
    return F.broadcast(names).join(summed, "i", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("entries", F.lit(0)).alias("entries"))


def sequences(texts: DataFrame, tokens: str, wanted: Sequence[Sequence[Sequence[str]]], added: str = "found") -> DataFrame:
    """texts with the numbers of those wanted sequences whose words stand in a row in the array of tokens; for each word of a
    sequence any of several forms will do. One pass: the forms of all words are looked for together, between marks that part
    the tokens, and the places where they stand are put together by sequence. Null arrays have none; no sequence is empty."""
    uses: dict[str, list[tuple[int, int]]] = {}
    for s, words in enumerate(wanted):
        if not words:
            raise ValueError("an empty sequence stands everywhere")
        for offset, forms in enumerate(words):
            for form in dict.fromkeys(forms):
                uses.setdefault(form, []).append((s, offset))
    forms = checked(list(uses))
    whole = [(1 << len(words)) - 1 for words in wanted]
    kept = texts.select([F.col(f"`{c}`") for c in texts.columns if c.lower() != added.lower()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton([f"\0{f}\0" for f in forms]) if forms else None
        of = [uses[f] for f in forms]
        for batch in batches:
            out = []
            for row in batch.column(tokens):
                row = row.as_py()
                if not row or machine is None:
                    out.append([])
                    continue
                # Neighbouring tokens share a mark, which a match takes at both ends: matches may overlap in it.
                marked = "\0" + "\0".join(t or "" for t in row) + "\0"
                places: dict[tuple[int, int], int] = {}
                at, token = 0, 0
                done: set[int] = set()
                for end, i in machine.iter(marked):
                    begin = end - len(forms[i]) - 1
                    token += marked.count("\0", at, begin)
                    at = begin
                    for s, offset in of[i]:
                        key = (s, token - offset)
                        places[key] = places.get(key, 0) | 1 << offset
                        if places[key] == whole[s]:
                            done.add(s)
                out.append(sorted(done))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, added])

    return kept.mapInArrow(find, StructType([*kept.schema.fields, *StructType.fromDDL(f"`{added}` array<int>").fields]))
