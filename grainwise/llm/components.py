"""Connected components of an edge table, by alternating stars; edges stay distributed.

In a round each node hands its larger neighbours, and then itself and its smaller ones, to the smallest of its
neighbourhood, until every component is a star around its smallest node. The number of rounds grows with the logarithm
of a component's length. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another node; root is the component's smallest node.

    edges: columns a and b of type long; loops, repeats and nulls do no harm. No edges give no rows.
    """
    both = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = common.materialise(edges.where("a <> b").select(*both).distinct(), "edges")
    seen = signature(now)
    while seen[0]:
        sym = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # As a table of its own, so that Spark can split a node with very many neighbours in the join.
        least = common.materialise(sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least-neighbours")
        large = sym.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.materialise(large.where("a <> b").distinct(), "large-star")
        # Now every pair points from the larger node (a) to the smaller (b).
        smallest = common.materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least-smaller")
        small = large.join(smallest.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        new = common.materialise(small.where("a <> b").select(*both).distinct(), "small-star")
        common.discard(now, large, least, smallest)
        now, before, seen = new, seen, signature(new)
        if seen == before:
            break
    out = now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    out._scratch = now._scratch  # for common.discard(), once it has been read
    return out


def signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(b, a))")).first()
    return tuple(row)
