"""Connected components of an edge list, by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node that can be reached.

    Each round is two groupings with partial sums before the shuffle and two joins that Spark can split where a node
    has many neighbours; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, before, round_no = written(pairs, "edges0"), None, 0
    while True:
        # large star: the larger neighbours of each node go to its smallest neighbour (or to itself, if it is that)
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of each node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("e"))
        round_no += 1
        pairs = written(moved.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), f"edges{round_no}")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
