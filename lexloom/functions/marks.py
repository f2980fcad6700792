"""Marks inside a line, found by one walk from left to right: nested markers, brackets with their depth, separators.

The walk keeps a place, its offset in UTF-16 units and the brackets that are open; it is linear in a line's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The systems of nested markers, the brackets that group spellings, and what parts these.
SYSTEMS = {"circled-katakana": "[㋐-㋾]", "parenthesized-number": "[⑴-⒇]", "ascii-parenthesized-number": r"\([0-9]{1,2}\)", "square-number": r"\[[0-9]{1,2}\]"}
OPEN, CLOSE, SEPARATOR = "⟪⟨", "⟫⟩", "・"
KINDS = [*SYSTEMS, "open", "close", "separator"]
MARK = re.compile("|".join(f"({p})" for p in (*SYSTEMS.values(), f"[{OPEN}]", f"[{CLOSE}]", SEPARATOR)))
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def walk(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """(kind, mark, place, offset in UTF-16 units, open brackets around it) of every mark. A closing bracket without an
    open one closes nothing."""
    depth = extra = before = 0
    narrow = ASTRAL.search(text) is None
    for m in MARK.finditer(text):
        kind, at = KINDS[m.lastindex - 1], m.start()
        if not narrow:
            extra += len(ASTRAL.findall(text, before, at))
            before = at
        if kind == "close":
            depth = max(0, depth - 1)
        yield kind, m[0], at, at + extra, depth
        if kind == "open":
            depth += 1


def pieces(text: str) -> list[str]:
    """The parts between separators that stand outside of all brackets."""
    out, begin = [], 0
    for kind, _, at, _, depth in walk(text):
        if kind == "separator" and depth == 0:
            out.append(text[begin:at])
            begin = at + 1
    return [*out, text[begin:]]


@F.arrow_udf(ArrayType(StructType([StructField("system", StringType()), StructField("marker", StringType()), StructField("offset", IntegerType())])))
def nested_markers(body: pa.Array) -> pa.Array:
    """The markers inside a body: system, marker, and offset in UTF-16 units, by offset."""
    found = [None if b is None else [{"system": k, "marker": m, "offset": o} for k, m, _, o, _ in walk(b) if k in SYSTEMS] for b in body.to_pylist()]
    return pa.array(found, pa.list_(pa.struct([("system", pa.string()), ("marker", pa.string()), ("offset", pa.int32())])))


@F.arrow_udf(ArrayType(StringType()))
def split_orthographies(value: pa.Array) -> pa.Array:
    """The parts between middle dots that stand outside of all brackets; null for null."""
    return pa.array([None if v is None else pieces(v) for v in value.to_pylist()], pa.list_(pa.string()))
