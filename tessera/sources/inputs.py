"""Category inputs, optional tables, and snapshots of trees and id lists that elsewhere come from a service."""

from __future__ import annotations

import glob
import hashlib
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sampling import first_occurrence
from tessera.sources.tables import read_delimited, require_files, resolve_column


def category_files(pattern: str) -> dict[str, str]:
    """category -> path of the files <category>__positive.csv that match a pattern, by category."""
    found = {}
    for path in sorted(glob.glob(pattern)):
        name = os.path.basename(path)
        if "__" in name:
            found[name.split("__", 1)[0]] = path
    return found


def load_categories(spark: SparkSession, paths: dict[str, str], canonical, column: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Distinct (category, value), the number of invalid rows of each category, and the files' digests.

    All missing files are named in one error; so is every category without a valid row.
    canonical: from a column to its canonical form, null or empty where it is invalid.
    """
    require_files(list(paths.values()))
    parts, out = [], None
    for category, path in paths.items():
        rows = read_delimited(spark, path)
        parts.append(rows.select(F.lit(category).alias("category"), canonical(F.col(resolve_column(rows.columns, column))).alias("value")))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    good = F.coalesce(F.col("value") != "", F.lit(False))
    counts = out.groupBy("category").agg(F.count_if(~good).alias("invalid"), F.count_if(good).alias("valid"))
    empty = set(paths) - {r["category"] for r in counts.where("valid > 0").collect()}  # a row for each category
    if empty:
        raise ValueError("no valid rows in: " + ", ".join(sorted(empty)))
    digests = {}
    for category, path in paths.items():
        with open(path, "rb") as f:
            digests[category] = hashlib.file_digest(f, "sha256").hexdigest()
    return out.where(good).distinct(), counts.select("category", "invalid"), digests


def category_map(spark: SparkSession, pattern: str, column: str | None = None) -> DataFrame:
    """(category, value, ordinal): the values of each category's file as they are, the first of equal ones, in file order."""
    out = None
    for category, path in category_files(pattern).items():
        rows = read_delimited(spark, path)
        name = resolve_column(rows.columns, column)
        part = rows.select(F.lit(category).alias("category"), F.trim(F.col(name)).alias("value"), F.monotonically_increasing_id().alias("ordinal")).where("value <> ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return first_occurrence(out, ["category", "value"], "ordinal")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, with the schema's columns, or an empty one if there is none."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    rows = read_delimited(spark, path)
    want = spark.createDataFrame([], schema).schema
    return rows.select(*((F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))


def read_tree(spark: SparkSession, path: str, nodes: str = "nodes", node_id: str = "id", name: str = "name", children: str = "children") -> DataFrame:
    """(id, parent, name, count) of a classification tree's snapshot: a JSON list of nodes with child ids; a root's parent is null."""
    with open(path) as f:
        found = json.load(f)
    rows = found[nodes] if isinstance(found, dict) else found
    up = {str(c): str(n[node_id]) for n in rows for c in n.get(children) or []}
    return spark.createDataFrame([(str(n[node_id]), up.get(str(n[node_id])), n.get(name), n.get("count")) for n in rows], "id string, parent string, name string, count long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct numbers of a text file with one id on a line; other lines are left out."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) as long)").alias("id")).where("id is not null").distinct()


def with_values(ids: DataFrame, values: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """ids with the value a map table has for them; ids without one are left out."""
    return ids.join(values.where(F.col(value).isNotNull()).dropDuplicates([key]), key)


def rendered(x: Column | str, style: str) -> Column:
    """A double as text: fixed6 (six decimals), general12 (twelve digits, nan), round4 (rounded, as a number), or short4 (four decimals, zeros stripped).

    By the binary value, as C's printf; the JVM would round the decimal text instead.
    """
    one = {
        "fixed6": lambda v: f"{v:.6f}",
        "general12": lambda v: f"{v:.12g}",
        "round4": lambda v: repr(round(v, 4)),
        "short4": lambda v: f"{v:.4f}".rstrip("0").rstrip("."),
    }[style]

    @F.pandas_udf("string")
    def render(v: pd.Series) -> pd.Series:
        return v.map(lambda d: ("nan" if style == "general12" else None) if pd.isna(d) else one(d))

    return render(x)
