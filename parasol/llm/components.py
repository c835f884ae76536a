"""Distributed connected components by alternating large-star and small-star.

Each round links a node's neighbours to the least node it knows, so the
distance to a component's least node shrinks quickly on any shape, stars and
chains alike. Every round is two aggregations and joins over the edge table,
written to the shared folder; nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour per node, combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of undirected edges between longs.

    Returns ``node`` and ``component`` (the least node reachable) for every
    node that has an edge. Loops and repeated edges do no harm; no edges give
    an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = stored(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
                   .filter("u <> v").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select(F.col("u"), F.least("u", "least").alias("m"))
        # large-star: neighbours above a node are linked to the least it knows
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small-star: neighbours below a node, and the node, are linked to the least of them
        large = stored(large, "large")
        low = _least(large).withColumnRenamed("least", "m")
        small = stored(large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
            .alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "small")
        # done when every node has one link, and to a node without one
        parents = small.groupBy("u").agg(F.count("*").alias("n"))
        open_ = (parents.filter("n > 1").limit(1).count()
                 or small.select(F.col("v").alias("u")).distinct().join(parents, "u", "left_semi").limit(1).count())
        links = small
        if not open_:
            break
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
