"""Questions about the order of a whole table, answered without bringing it, or one group of it, into one task.

Numbers and running sums: rows are dealt by range of the order, each partition is numbered and summed by itself, and what
lies before a partition is added to it; of each partition the driver sees its totals only. Order statistics: the digits of a
value's bits are counted, from the highest down, and each rank follows the digit in which it falls, so no more than a
histogram of one digit is held for a group and rank; where few rows are left these are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import durable

#: Bits in a digit of a value, and rows of one digit that are ranked rather than counted on.
DIGIT = 12
FEW = 10_000
#: Groups and ranks up to this number are sent to all tasks; more meet the rows by a shuffle.
SMALL = 100_000
WHOLE = {"tinyint", "smallint", "int"}


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, str] | None = None, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """rows with their number in the order, from 0, and running sums (`sums`: new column by a column of whole numbers or
    doubles; nulls add nothing). The order should be total: rows that agree in it are numbered in any order, and lie in one
    partition together."""
    sums, spark = sums or {}, rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = {c.lower() for c in rows.columns}
    clash = [c for c in (name, *sums) if c.lower() in taken]
    if clash:
        raise ValueError(f"rows have a column {clash[0]} already")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("order_part", F.spark_partition_id())
    kinds = {new: "double" if dict(rows.dtypes)[old] in ("double", "float") else "bigint" for new, old in sums.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, upto = 0, dict.fromkeys(sums, 0)
        for batch in batches:
            new = [pa.array(np.arange(at, at + batch.num_rows))]
            at += batch.num_rows
            for c, old in sums.items():
                kind = pa.float64() if kinds[c] == "double" else pa.int64()
                so_far = np.cumsum(np.asarray(pc.fill_null(batch.column(old).cast(kind), 0))) + upto[c]
                upto[c] = so_far[-1] if len(so_far) else upto[c]
                new.append(pa.array(so_far, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, name, *sums])

    added = StructType.fromDDL(", ".join([f"`{name}` bigint", *(f"`{c}` {k}" for c, k in kinds.items())]))
    numbered = durable(dealt.mapInArrow(add, StructType([*dealt.schema.fields, *added.fields])))
    ends = numbered.groupBy("order_part").agg(F.count("*").alias("n"), *(F.max_by(c, name).alias(c) for c in sums)).orderBy("order_part").collect()
    before, held = [], [0, *(0.0 if k == "double" else 0 for k in kinds.values())]
    for r in ends:  # one row a partition
        before.append((r.order_part, *held))
        held = [held[0] + r.n, *(h + (r[c] or 0) for h, c in zip(held[1:], sums, strict=True))]
    columns = [f"before_{i}" for i in range(len(held))]
    schema = ", ".join(["order_part int", f"{columns[0]} bigint", *(f"{c} {k}" for c, k in zip(columns[1:], kinds.values(), strict=True))])
    known = F.broadcast(spark.createDataFrame(before, schema))
    moved = [(F.col(c) + F.col(b)).alias(c) for c, b in zip((name, *sums), columns, strict=True)]
    return numbered.join(known, "order_part").select(*(F.col(f"`{c}`") for c in rows.columns), *moved)


def _bits(kind: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column], int]:
    """How values become whole numbers whose unsigned order is theirs, how they come back, and of how many bits they are."""
    if kind in WHOLE:
        return lambda v: v.cast("bigint") + F.lit(1 << 31), lambda b: (b - F.lit(1 << 31)).cast(kind), 32
    sign = F.lit(-(1 << 63))
    if kind == "bigint":
        return lambda v: v.bitwiseXOR(sign), lambda b: b.bitwiseXOR(sign), 64
    if kind not in ("float", "double"):
        raise ValueError(f"no order statistics of {kind}")

    @F.arrow_udf("long")
    def to(v: pa.Array) -> pa.Array:
        x = np.asarray(pc.fill_null(v.cast(pa.float64()), 0.0)) + 0.0  # minus zero is zero
        x = np.where(np.isnan(x), np.nan, x)
        b = x.view(np.int64)
        return pa.array(np.where(b < 0, ~b, b ^ np.int64(-(1 << 63))))

    @F.arrow_udf("double")
    def back(v: pa.Array) -> pa.Array:
        b = np.asarray(pc.fill_null(v, 0))
        return pa.array(np.where(b < 0, b ^ np.int64(-(1 << 63)), ~b).view(np.float64), mask=np.asarray(pc.is_null(v)))

    return to, back, 64


def order_statistics(rows: DataFrame, value: str, keys: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and a column each of `ranks`: the value at a rank (from 1) that is told from a group's number n of values.

    Nulls are no values; groups without any have no row. NaN comes after all numbers. Null keys form a group. Exact at any
    size: a group's values are counted by digit, never gathered.
    """
    to, back, left = _bits(dict(rows.dtypes)[value])
    own = [f"key_{i}" for i in range(len(keys))] or ["key_0"]
    named = [F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)] if keys else [F.lit(1).alias("key_0")]
    base = rows.filter(F.col(f"`{value}`").isNotNull()).select(*named, to(F.col(f"`{value}`")).alias("bits"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for c, rank in ranks.items())))
    counts = durable(base.groupBy(*own).agg(F.count("*").alias("n")))
    goals = counts.select(*own, each.alias("x"), F.col("n").alias("held")).select(*own, "x.name", "x.rank", F.lit(0).cast("long").alias("prefix"), "held")

    def upper(shift: int) -> Column:
        return F.lit(0).cast("long") if shift >= 64 else F.shiftrightunsigned("bits", shift)

    def meet(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """Joined on keys, null ones too, and prefix, with the columns of other named g_...; other is a table of goals."""
        other = other.select(*(F.col(c).alias(f"g_{c}") for c in other.columns))
        same = F.col("prefix") == F.col("g_prefix")
        for o in own:
            same = same & F.col(o).eqNullSafe(F.col(f"g_{o}"))
        return df.join(F.broadcast(other) if few else other, same, how)

    few, first = True, True
    while left:
        if goals.isEmpty() or (not first and (goals.agg(F.max("held")).first()[0] or 0) <= FEW):
            break
        step = min(DIGIT, left)
        left -= step
        some = base.select(*own, upper(left + step).alias("prefix"), upper(left).bitwiseAND(F.lit((1 << step) - 1)).alias("digit"))
        if not first:
            some = meet(some, goals.select(*own, "prefix").distinct(), "left_semi")
        cells = some.groupBy(*own, "prefix", "digit").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*own, "prefix").orderBy("digit"))
        cells = cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        found = meet(cells, goals, "inner").filter("before < g_rank and g_rank <= upto")
        goals = durable(found.select(*own, F.col("g_name").alias("name"), (F.col("g_rank") - F.col("before")).alias("rank"), F.shiftleft("prefix", step).bitwiseOR(F.col("digit")).alias("prefix"), F.col("n").alias("held")))
        few, first = goals.limit(SMALL + 1).count() <= SMALL, False
    if left:  # few rows share a goal's digits so far
        some = meet(base.withColumn("prefix", upper(left)), goals.select(*own, "prefix").distinct(), "left_semi")
        place = F.row_number().over(Window.partitionBy(*own, "prefix").orderBy(F.col("bits").bitwiseXOR(F.lit(-(1 << 63)))))
        ranked = some.withColumn("place", place)
        goals = meet(ranked, goals, "inner").filter("place = g_rank").select(*own, F.col("g_name").alias("name"), F.col("bits").alias("prefix"))
    told = goals.select(*own, "name", back(F.col("prefix")).alias("value"))
    wide = told.groupBy(*own).agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in ranks))
    wide = wide.select(*(F.col(o).alias(f"w_{o}") for o in own), *ranks)
    same = F.lit(True)
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"w_{o}"))
    out = counts.join(wide, same).select(*own, "n", *ranks)
    return out.select(*(F.col(o).alias(k) for o, k in zip(own, keys, strict=False)), "n", *ranks)
