"""Deterministic splits, buckets and samples by hash; none depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalar as S


def split_column(key: Column, shares: tuple[float, float] = (0.6, 0.8)) -> Column:
    """train, validation or test, by the fraction of the group key's hash: no group lies in two."""
    x = S.hash_fraction(key)
    return F.when(x < shares[0], "train").when(x < shares[1], "validation").otherwise("test")


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split; none must."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def hash_sample(rows: DataFrame, key: str, k: int, salt: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """The k rows (of each group) with the least SHA-256 of salt|key, ties by the key.

    Without groups it is a top-k plan, which keeps k rows for each task; with
    groups the rank filter lets each task keep k rows for each group.
    """
    text = F.col(key).cast("string")
    digest = S.sha_hex(F.concat(F.lit(f"{salt}|"), text) if salt is not None else text)
    if not keys:
        return rows.withColumn("__h", digest).orderBy("__h", text).limit(k).drop("__h")
    order = W.partitionBy(*keys).orderBy("__h", text)
    return rows.withColumn("__h", digest).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__h", "__r")


def capped_per_category(rows: DataFrame, key: str, category: str, total: int, salt: str) -> DataFrame:
    """At most ceil(total / categories) rows of each category, by hash."""
    n = rows.select(category).distinct().count()
    return hash_sample(rows, key, -(-total // max(n, 1)), salt, [category])


def first_occurrence(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of least ordinal for each key: aggregation, so map-side combined."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(F.col(ordinal).alias("__o"), *rest)).alias("__s"))
    return best.select(*keys, *(F.col(f"__s.{c}").alias(c) for c in rest)).select(*rows.columns)


def seen_before(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Whether a row's key occurs at a smaller ordinal."""
    first = rows.groupBy(key).agg(F.min(ordinal).alias("__first"))
    return rows.join(first, key, "left").withColumn("seen_before", F.coalesce(F.col(ordinal) > F.col("__first"), F.lit(False))).drop("__first")
