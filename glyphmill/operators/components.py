"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.skew import skewed_join
from glyphmill.plans.cut import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of u is hung on the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return skewed_join(both.where("v > u"), least, ["u"], 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """u and its smaller neighbours are hung on the least of them. Rows here have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = skewed_join(edges, least, ["u"], n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its least node.

    edges: columns u and v of one orderable type, in any direction, repeats and self-loops allowed. Rows with a
    null end are no edges. Each round is cut by a checkpoint in the shared folder; only a count and a checksum
    come to the driver. A node with a large share of the edges is spread (see ``skewed_join``).
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    state = _state(now)
    while state[0]:
        hung = checkpointed(_large_star(now, state[0]))
        now = checkpointed(_small_star(hung, state[0]))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
