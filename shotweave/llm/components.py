"""Connected components by alternating large-star and small-star over a table of edges."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, let_go


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of an edge (u, v); loops and repeated edges do no harm.

    Both steps only group by a node and take a minimum, so a hub's edges are folded before the shuffle and its join is one Spark can split.
    Every round is cut by a checkpoint; rounds grow with the logarithm of a component's size.
    """
    edges = cut_lineage(edges.select("u", "v").where("u != v").distinct())
    sign = None
    while True:
        edges = cut_lineage(_small(_large(edges)).where("u != v").distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        let_go(edges.sparkSession)
        if new == sign:
            break
        sign = new
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
