"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each u (or u itself); a table of its own, so that joins with it can split hot keys."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in the edges (u, v): component is the least node reachable.

    Self-loops, repeated and reversed edges are fine; no edges give no rows.
    Every step's edges are a table in the shared folder, so no lineage grows and
    lost executors cost one step.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:  # each round at least halves the longest way to a root, up to a constant
        # Large star: larger neighbours point at the least one.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both)
        large = cut(both.join(m, both.u == m.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        drop_cut(m)
        # Small star: a node and its smaller neighbours point at the least of them.
        m = _least(large)
        down = large.join(m, large.u == m.k).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(down.union(m.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        drop_cut(m)
        drop_cut(large)
        drop_cut(now)
        now = small
        # Settled: each node points at one other, which points nowhere.
        ways = now.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in_")).union(now.select("v", F.lit(0), F.lit(1)))
        if ways.groupBy("n").agg(F.sum("out").alias("out"), F.max("in_").alias("in_")).where("out > 1 or out = 1 and in_ = 1").isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
