"""Connected components of an edge table by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import saved


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); ``root`` is the smallest node of its component.

    Large stars hang a node's larger neighbours on the smallest one around it,
    small stars its smaller ones; the table stays as large as the edges and
    ends as one star per component.  A node with a third of all edges is a
    partial aggregate and one side of a plain join, which adaptive execution
    splits.
    """
    now, print_now = saved(_oriented(edges), "edges"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Saved, so that no plan has more than a handful of exchanges.
        large = saved(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(root.select("u", F.col("m").alias("v")))
        now = saved(_oriented(small), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == print_now:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .union(now.select("v", "v").distinct())
        print_now = mark
