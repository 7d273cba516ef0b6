"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("v", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = _both_ways(edges)
    least = both.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m"))
    moved = both.join(least, F.col("u") == F.col("_n")).where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("_m", "u").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("_n")).agg(F.min("v").alias("_m"))
    moved = down.join(least, F.col("u") == F.col("_n")).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return moved.union(least.select("_n", "_m"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (columns u, v); the root is the component's smallest node.

    Loops and repeated edges change nothing. Each step is written to the shared folder, which cuts the
    lineage; no step gathers a node's neighbours.
    """
    now, before = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
