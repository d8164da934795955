"""Connected components of a graph given by its edges, in rounds of two star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, join_hot, written


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Tie the neighbours of each node (large: the larger ones; else the smaller ones and itself) to the smallest.
    There are ``n`` edges, or somewhat fewer."""
    swapped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(swapped) if large else edges
    least = written(
        near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    )
    hubs = least.filter(F.col("n") > max(HOT_ROWS, n // HOT_SHARE)).select("u")
    tied = join_hot(near, least.drop("n"), "u", hubs)
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``; root is the component's smallest node.

    Minima are added up before they are dealt, and what a hub has is joined in many tasks, not gathered. Each round's edges are written; the number of rounds grows with the logarithm of a component's
    diameter. Loops and edges with a null end are ignored, repeated edges count once, no edges give no rows.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        now = written(_star(written(_star(now, True, mark[0])), False, mark[0]))
