"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, let_go


def stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges (u, v) has one v, and no v is a u."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(low).alias("low"), F.lit(1 - low).alias("high")) for c, low in (("u", 1), ("v", 0))])
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return nodes.filter("low + high > 1 and low > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node with an edge.

    edges: u, v of one orderable type. Large-star and small-star steps in turn, until the edges are stars: each links the
    neighbours of a node to their least, so the edges never grow in number and end as stars. Every round is kept in
    the shared folder. A node of very many neighbours is a skewed key of a join, which adaptive execution splits.
    Edges that are stars already take no round. What a round leaves behind is let go.
    """
    now = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: greater neighbours of u move to the least of u and its neighbours.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now = durable(small)
        del both, least, large, low, small
        let_go(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
