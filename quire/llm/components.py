"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b), a > b: each node's larger neighbours are hung on the least of its neighbours and itself.

    The least ones are a table of their own, so that a node with many links can be split in the join."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
    return both.join(least, "a").filter((F.col("b") > F.col("a")) & (F.col("b") > F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links (a, b), a > b: each node and its smaller neighbours are hung on the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.filter(F.col("a") > F.col("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every link hangs a node on a root: no node hangs on two, none that hangs has others hanging on it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of the links (a, b); component: the least node that can be reached.

    The links shrink to stars around the least nodes; each round is written, so its cost does not add up."""
    at = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    k = 0
    while not _stars(at):
        k += 1
        large = scratch.table(_large_star(at, scratch, f"{name}-{k}-least"), f"{name}-{k}-large")
        at = scratch.table(_small_star(large), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-least", f"{name}-{k}-large", f"{name}-{k - 1}")
    roots = at.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
