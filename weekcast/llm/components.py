"""Connected components by alternating large-star and small-star steps.

All links stay in Spark. A node's smallest neighbour comes from an aggregation with a
map-side minimum and is written; the links then join it, and as both sides of that join are
plain shuffles, Spark splits the links of a node that has very many. Each round is written
to the shared folder, so the plan stays short and a lost executor costs a re-read; the round
before is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import forget, write_once


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): ``node, root`` of every node that has a link to another one; root is
    the smallest node reachable. Links to itself or to null count for nothing; empty links
    give an empty table."""
    edges = write_once(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _is_forest(edges):
        for step in (_large, _small):
            before, low = edges, write_once(_lowest(edges, step is _large))
            edges = write_once(step(before, low))
            forget(before)
            forget(low)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node, which is linked to no smaller one."""
    sides = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    met = sides.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return met.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _lowest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's smallest neighbour, or smallest smaller one; itself if none is smaller."""
    sides = edges.union(edges.select("b", "a")) if both_ways else edges
    return sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))


def _large(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    return edges.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("low").alias("b")).distinct()


def _small(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    moved = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return low.select("a", F.col("low").alias("b")).union(moved).distinct()
