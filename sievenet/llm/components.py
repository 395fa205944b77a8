"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum, combined before the shuffle, and an equi-join whose other side has one row a
node; the links of one node with very many meet in that join, where adaptive execution splits them.  A small
table is stepped through in one task, so that a round costs no shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievenet.llm.tables import compact, saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component: the smallest node of its component.

    links: (a bigint, b bigint), either direction, repeats and self-links allowed; rows with a null are left out.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        edges = compact(edges, 16)
        # large star: the larger neighbours of a node move to its smallest neighbour
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = saved(moved.where("u != v").distinct(), "edges")
        # done when no root hangs below another node
        if edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty():
            break
    pairs = compact(edges, 16).groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
