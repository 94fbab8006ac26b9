"""Connected components of an edge table, by large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Edges may repeat, point either way or join a node with itself; those with a null end are ignored. Nodes are of any
    type with an order. Each step writes a table in the shared folder; the number of steps grows with the logarithm of
    the longest chain. A node with very many edges is met by partial minima and by joins that Spark may split.
    """
    nodes = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = materialise(nodes.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        facts = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not facts[0] or facts == before:
            break
        before = facts
        now = materialise(_small_star(_large_star(now)), "edges")
    # every edge now joins a node with its root
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours with the smallest of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
