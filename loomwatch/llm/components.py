"""Connected components of an edge table by alternating label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.shared import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Large-star and small-star rounds: every node hangs its larger neighbours,
    then its smaller ones, below its least neighbour, until nothing changes.
    Rounds grow with the logarithm of the longest path. Each round's table is
    written to the shared folder, so a lost executor costs one round at most;
    a star's rows are dealt by node with partial aggregates, and no task holds
    a component.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = stored(pairs, "components")
    mark = None
    for _ in range(most_rounds):
        # large star: neighbours larger than a node go to the least of it and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = stored(small.filter("u <> v").distinct(), "components")
        new = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
