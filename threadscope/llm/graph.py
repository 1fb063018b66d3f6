"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge table; component is the least node.

    Each step keeps one row a link and replaces links by links to a smaller
    neighbour, so the table never grows; a node with very many neighbours is a
    skewed join key of two shuffled sides, which adaptive execution splits."""
    e = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
                    .where("v != u").distinct(), "edges")
    while True:
        # large star: a node's larger neighbours link to its least neighbour
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = (both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                 .where("v != u").distinct())
        # small star: a node and its smaller neighbours link to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        e = materialize(joined.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u")
                        .union(least.select("v", F.col("m").alias("u"))).distinct(), "edges")
        # done when all links are stars: no node is both a centre and a ray
        if not e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            break
    labels = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return labels.union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
