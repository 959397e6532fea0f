"""Connected components of a link table, by alternating large and small stars.

Each round points every vertex's neighbours at the least vertex near it; after a
number of rounds that grows with the logarithm of the longest chain, each
component is a star around its least vertex.  A vertex with very many links is
handled by partial minima and skew joins, never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._session import cut


#: Edges (16 bytes each) up to which a round runs in one task.
FEW = 100_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    return r[0], r[1]


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) between different longs -> (vertex, component) of every vertex that has a link; component is the least vertex."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, before = _state(edges), None
    # so few edges are one partition's work: its rounds need no exchange
    packed = (lambda df: df.coalesce(1)) if now[0] <= FEW else (lambda df: df)
    while now != before:
        before = now
        both = packed(edges).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every row is (larger, smaller)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(packed(small.unionByName(low.select("a", F.col("m").alias("b")))).distinct())
        now = _state(edges)
    stars = packed(edges).groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "vertex")
    return stars.unionByName(packed(edges).select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct().join(stars.select("vertex"), "vertex", "left_anti"))
