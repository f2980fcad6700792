"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact word length. A source's target is first met by whole passes over the source;
the words then missing are fitted from its histogram: beyond a window of words every length gives its proportional share,
and a bounded knapsack over what is left chooses how many documents of each length close the gap. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

# Fixed values of the contract: weights by turns, the share of all words that the mix has, passes over a source at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 17
#: Words that the knapsack works on first; if these don't meet the budget, twice the longest length of the source.
WINDOW = 1 << 16
#: The order of documents within a length is by so many buckets, then by hash within the one bucket that is cut.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, with one row a source.

    Sources in code-point order, null last, have the weights by turns. A target is min(epochs * size, level * weight)
    at the one level that shares out `share` of all words: sources are capped in the order of size / weight, and the
    level follows from running sums. Only this table of sources is ordered as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("cap", (epochs * F.col("source_size")).cast("double"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    # The level is that of the first source which it does not cap, and falls from there on: the greatest such. If all
    # sources are capped there is none.
    ok = F.col("cap") / F.col("weight") >= F.col("level")
    per = per.withColumn("level", level).withColumn("level", F.max(F.when(ok, F.col("level"))).over(everything))
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to the budget from below.

    0 <= budget <= the words of all. A budget within the window is met by a bounded knapsack over all documents, and so as
    nearly as any choice of them can. A greater one is met by proportional shares first, of which documents of all lengths
    are given back until half the window is open, and a knapsack over all that aren't taken. A budget that is missed is
    tried again with a window of twice the longest length; then it is exact for budgets up to that.
    """
    take = _fill(lengths, counts, budget, window)
    wide = 2 * int(lengths.max(initial=0))
    if wide > window and int((take * lengths).sum()) < budget:
        other = _fill(lengths, counts, budget, wide)
        if int((other * lengths).sum()) > int((take * lengths).sum()):
            return other
    return take


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), dtype=np.int64)
    if not total or budget <= 0:
        return take
    gap = budget
    if budget > window:
        # Integer division in Python's own integers: no product overflows.
        take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
        # Half the window is given back, evenly by words, so that short documents may be chosen anew, all of them.
        take -= np.minimum(take, window // 2 // len(lengths) // lengths)
        gap = budget - int((take * lengths).sum())
        for i in np.argsort(-lengths, kind="stable").tolist():
            if gap <= window:
                break
            more = min(int(counts[i] - take[i]), max(0, (gap - window // 2) // int(lengths[i])))
            take[i] += more
            gap -= more * int(lengths[i])
        # Long ones are given back one of each length in turn, the short first, as far as they fit.
        while gap < window // 2:
            back = np.flatnonzero((take > 0) & (np.cumsum(np.where(take > 0, lengths, 0)) <= window - gap))
            if not len(back):
                break
            take[back] -= 1
            gap += int(lengths[back].sum())
    added = knapsack(lengths, counts - take, min(gap, window))
    return take + added


def knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length make the greatest sum that is at most the goal.

    Sums that can be reached are the bits of one integer; a length is added in groups of 1, 2, 4, ... documents. Of each sum
    the group that first reached it is kept, whose rest was reached by groups before it: one number a sum, however many
    lengths there are.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    mask, reach = (1 << (goal + 1)) - 1, 1
    groups: list[tuple[int, int]] = []
    by = np.zeros(goal + 1, dtype=np.int32)
    for i in np.flatnonzero((lengths <= goal) & (counts > 0)).tolist():
        length = int(lengths[i])
        rest, group = min(int(counts[i]), goal // length), 1
        while rest and not reach >> goal & 1:
            n = min(group, rest)
            new = ((reach << (n * length)) & mask) & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(goal // 8 + 1, "little"), dtype=np.uint8)
                full = np.flatnonzero(bits)
                at = (full[:, None] * 8 + np.arange(8))[np.unpackbits(bits[full], bitorder="little").reshape(-1, 8) > 0]
                by[at] = len(groups)
                groups.append((i, n))
                reach |= new
            rest, group = rest - n, group * 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    while at:
        i, n = groups[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: passes over all of it, and the number of documents of each length that get one more."""
    target, size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    passes = int(target // size) if size else 0
    budget = min(int(round(target - passes * size)), size)
    pdf = pdf.sort_values("size")
    extra = fill(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "extra": extra})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, hash (of the text) for every row of docs (doc_id, text, source).

    Null and empty texts have size 0 and are never taken; very long ones are counted whole. Rows with a null source form
    a source of their own. Repeated rows count each by itself; among rows of one source, length, id and text the choice
    is between equals. Other columns of docs are ignored, whatever their names.
    """
    count = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(BUCKETS)).cast("int")
    rows = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash")).withColumn("bucket", count))
    goals = durable(targets(rows))
    # Lengths of one source meet in one group: as many rows as it has different lengths, not documents.
    cells = durable(rows.filter("size > 0").groupBy("source", "size", "bucket").agg(F.count("*").alias("n")))
    histogram = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = F.col("h.source").eqNullSafe(F.col("g.source"))
    plan = (
        histogram.alias("h")
        .join(goals.alias("g"), same)
        .select("h.source", "h.size", "h.n", "g.source_size", "g.target")
        .groupBy("source")
        .applyInPandas(_plan, "source string, size long, passes long, extra long")
    )
    # Whole buckets of a length are taken while they fit; the bucket that is cut is ranked by hash. A length of very
    # many documents so has its rows counted, and at most one bucket's rows ordered.
    upto = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    budget = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("c")
    plan = plan.alias("p")
    here = F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size"))
    cut = budget.join(plan, here).select(
        "c.source", "c.size", "c.bucket", "c.n", "p.passes", F.greatest(F.lit(0), F.least(F.col("c.n"), F.col("p.extra") - F.col("c.before"))).alias("quota")
    )
    cut = durable(cut)
    key = F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.size") == F.col("k.size")) & (F.col("r.bucket") == F.col("k.bucket"))
    placed = rows.alias("r").join(cut.alias("k"), key, "left").select("r.*", "k.n", "k.passes", "k.quota")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "hash"))
    partly = placed.filter("quota > 0 and quota < n").withColumn("one", (rank <= F.col("quota")).cast("long"))
    wholly = placed.filter("quota is null or quota = 0 or quota = n").withColumn("one", (F.coalesce("quota", F.lit(0)) > 0).cast("long"))
    taken = wholly.unionByName(partly).withColumn("taken", (F.coalesce("passes", F.lit(0)) + F.col("one")) * F.col("size")).alias("t")
    return taken.join(goals.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).select("t.doc_id", "t.source", "t.size", "g.source_size", "g.target", "t.taken", "t.hash")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "hash")
