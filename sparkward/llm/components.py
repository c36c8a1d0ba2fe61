"""Connected components of a graph in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rounds after which something must be wrong; each at least halves long chains.
ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest node that each node of links (a, b) reaches: node, component.

    Alternates large-star and small-star steps: each node's larger neighbours, then its smaller
    ones, are linked to the smallest neighbour, until every component is a star. Steps are
    aggregations and joins by node; a node of very many links is a key that Spark can split. Nodes
    without links aren't in the result; nulls, loops and repeated links don't count.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("node")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("node"))
        old, edges = edges, written(small.select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")
        ).filter("u <> v").unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components haven't settled after {ROUNDS} rounds")
