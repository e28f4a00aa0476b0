"""Connected components of a link table, by joins and sums only."""

from pyspark.sql import DataFrame, functions as F

from .store import mark, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable from each node that has a link.

    Alternates two contractions until nothing changes: each node's larger
    neighbours, then its smaller ones, are linked to the smallest node of its
    neighbourhood. A node with very many links is only ever summed up and
    joined, and Spark splits its partition of the join. Each round is written
    to the shared folder. Null ends and self-links are left out; no links give
    no rows.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    begin = mark()
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star", since=begin)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star", since=begin)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
