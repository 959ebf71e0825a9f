"""Connected components of a table of links, by alternating large and small stars on Spark.

Each round is two aggregations to a minimum and joins; hubs are joined, not collected, and the rounds follow the
logarithm of the longest path. Minima are written before they are joined, so that both sides of a join come straight from a shuffle
and Spark can split a hub's rows over tasks. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ptclake.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "links-least")
    joined = edges.join(least, "u")
    return joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of any order and with repeats to ``(node, root)``: root is the smallest node reachable.

    Only nodes with a link to another are listed; the root itself isn't. Links with a null end or between equal ends
    count as none.
    """
    ends = links.filter(F.col("u") != F.col("v"))
    edges = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while True:
        large = materialize(_large_star(edges).distinct(), "links-large")
        before, edges = edges, materialize(_small_star(large).distinct(), "links")
        discard(before, large)
        if (now := _mark(edges)) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
