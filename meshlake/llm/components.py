"""Connected components by alternating star contractions, as Spark joins.

A large star links every greater neighbour of a node to the least of its neighbourhood, a
small star links the lesser ones.  Both keep components as they are, and together they
end, after a few rounds, with every node linked to the least of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST, keep


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (longs ``a``, ``b``); the root is the least node it reaches.

    Direction, repeats and loops of edges do not matter; edges with a null end are none.
    """
    edges = keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes, last, n = edges, None, edges.count()
    while True:
        both = edges.union(edges.select("v", "u"))
        # one row a node: few of them are broadcast, so that a node with very many edges makes no large task
        side = F.broadcast if 2 * n <= BROADCAST else lambda df: df
        least = side(both.groupBy("u").agg(F.min("v").alias("m")))
        edges = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        least = side(edges.groupBy("u").agg(F.min("v").alias("m")))
        stars = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = keep(stars.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, n = now, now[0]
    named = nodes.select("u").union(nodes.select("v")).distinct().toDF("node")
    return named.join(edges.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
