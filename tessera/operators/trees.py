"""Hierarchies: flattening with depth and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(nodes: DataFrame, node: str, parent: str, name: str, most_depth: int = 50) -> DataFrame:
    """node, depth (roots 0), path of names joined by ' > ', and whether it is a leaf.

    One join for each level; a level's rows are only those just reached.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    level = rows.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out = level
    for depth in range(1, most_depth + 1):
        up = level.select(F.col("node").alias("parent"), F.col("path").alias("up"))
        level = rows.join(up, "parent").select("node", F.lit(depth).alias("depth"), F.concat_ws(" > ", "up", "name").alias("path"))
        if level.isEmpty():
            break
        out = out.unionAll(level)
    parents = rows.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    return out.join(parents.withColumn("inner", F.lit(True)), "node", "left").select("node", "depth", "path", F.col("inner").isNull().alias("is_leaf"))


def build_targets(flat: DataFrame, prefix: str, counts: DataFrame, least: int) -> DataFrame:
    """Leaves below a path prefix with at least so many members (counts: node, n)."""
    return flat.where(F.col("path").startswith(prefix) & F.col("is_leaf")).join(counts, "node").where(F.col("n") >= least)
