"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import cut


#: Tasks that the links of one node are dealt to.
SALTS = 8


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star rounds over links that point from the larger to the smaller node. Each
    round halves the depth of the forest and cuts lineage; the last one leaves stars, where each node has one link or is
    the smallest of its component. Minima are combined before the shuffle, and the join back to the links of a node is
    salted, so a node with a third of all links is no hot group.
    """
    x, y = F.col(a), F.col(b)
    edges = cut(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while not stars(edges):
        # large star: every neighbour larger than u is linked to the smallest node around u, or to u itself
        both = ends(edges, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = edges.select(F.col("u").alias("big"), F.col("v").alias("u"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int").alias("s"))
        large = dealt.join(salted, ["u", "s"]).select(F.col("big").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = ends(small, F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def ends(rows: DataFrame, *pairs: Column) -> DataFrame:
    """(u, v): each of `pairs` from each row, which is read once."""
    return rows.select(F.inline(F.array(*pairs)))


def stars(edges: DataFrame) -> bool:
    """Whether no node has two links to smaller ones, or one and a link to a larger one."""
    seen = ends(edges, F.struct("u", F.lit(1).alias("v")), F.struct(F.col("v").alias("u"), F.lit(0).alias("v")))
    seen = seen.groupBy("u").agg(F.sum("v").alias("n"), F.min("v").alias("least"))
    return seen.where("n > least").limit(1).count() == 0
