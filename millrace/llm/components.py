"""Connected components of links between 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, forget


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). A row for each node of a link: node, root (the component's smallest node).

    A large star ties each node's larger neighbours to the smallest node near it, a small star does so with the
    smaller ones; links never grow in number, and rounds end, as each but the
    last lowers what nodes hang on (about the logarithm of the longest chain squared, mostly far fewer). Each round is two aggregations, and its result is written out. A node
    with very many neighbours isn't gathered: its minimum comes from a partial aggregation and is joined back.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        near = both.join(least, "a")
        far = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return far.filter("a != b").distinct()

    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        old, edges = edges, durable(star(star(edges, True), False))
        forget(old)
        # all stars have their smallest node in the middle, once no centre hangs on another node
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
