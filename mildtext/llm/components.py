"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of all nodes of ``links`` (``a``, ``b``).

    Alternating large-star and small-star steps: every step hangs neighbours under the
    smallest node that is known to each, until all links are stars around the smallest.
    A hub's links are rows of their own and are never gathered.  Links to null and from a node to
    itself say nothing; repeated links count once; no links: no rows.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # every neighbour above a node moves to the smallest around the node
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every neighbour below a node, and the node, move to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct())
        after = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
