"""Connected components of a distributed graph.

Alternates the large-star and small-star steps of Kiveris et al. (2014): each
node's neighbours are linked to the smallest node among them, so every
component becomes a star around its smallest node after about the logarithm of
the largest component's size in rounds.  Each step is an aggregate with a
partial sum before the shuffle and an equi-join; no neighbour list is ever
collected.  Every round writes its links to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.session import durable, release


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours v of each u to the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = directed.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the component's smallest node.

    Links may repeat, come in either order or join a node to itself (which
    names a component of its own only if no other link holds the node).
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = durable(links.where("u != v").select(big.alias("u"), small.alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(_star(both, True), "large-star")
        after = durable(_star(large, False), "small-star")
        release(large)
        # both tables hold distinct links, so equal counts of the union mean no change
        total = now.unionByName(after).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n < 2")
        done = total.isEmpty()
        release(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
