"""Connected components of an edge table by alternating large and small stars, all in DataFrames.

The label of a component is its smallest node. Each round is two minima per node (pre-aggregated before the
shuffle) joined back to the edges (joins that AQE can split where a node has very many edges), stored so that a lost
executor costs one round at most. Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or not larger) neighbours to its smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # the minima's node is computed anew, so that they too have a plain exchange and AQE can split a node of very many edges
    joined = both.join(shuffled(least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m")), "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(``u``, ``v``) bigint links -> (``node``, ``component``), for every node of a link."""
    link = lambda e: stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = link(edges)
    now = state(edges)
    while now[0]:
        edges = link(_star(_star(edges, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), False))
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct()
