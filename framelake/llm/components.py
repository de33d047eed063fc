"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framelake.workspace import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours, or the smaller ones and the node.

    The minimum per node is combined before its shuffle. A node with very many neighbours is never
    brought together: the join back leaves its rows where skew handling can split them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("root"))
        moved = both.filter("b > a").join(least, "a").select("b", "root")
    else:
        down = both.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("root"))
        moved = down.join(least, "a").select("b", "root").union(least.select(F.col("a").alias("b"), "root"))
    return moved.filter("b <> root").select(F.col("root").alias("a"), "b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge.

    Rounds grow with the logarithm of a component's diameter. Each round is written to the shared
    folder, so a lost executor costs one round at most. Edges with a null end are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    links = materialize(
        pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    before = None
    while True:
        links = materialize(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
