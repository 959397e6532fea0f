"""Table sources and sinks: delimited files, column resolution, guards."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that may hold the input structure or text, in the order they are tried.
INPUT_COLUMNS = ("SMILES", "smiles", "Smiles", "canonical_smiles", "text")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table with header, all columns as text; tab for .tsv and .tab, else comma; a byte-order mark before the first name is dropped."""
    sep = "\t" if path.lower().endswith((".tsv", ".tab")) else ","
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def resolve_column(columns: list[str], preferred: str | None = None, mode: str = "exact") -> str:
    """The input column: the preferred one if it is there, else the first known name; mode 'nocase' ignores case."""
    if preferred:
        if preferred in columns:
            return preferred
        raise ValueError(f"no column {preferred!r}")
    for name in INPUT_COLUMNS:
        for c in columns:
            if c == name or (mode == "nocase" and c.lower() == name.lower()):
                return c
    raise ValueError(f"none of {INPUT_COLUMNS} among {columns}")


def coalesce_first(rows: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """value: the first of the columns that isn't blank, trimmed; the first occurrence of each value."""
    value = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))
    return rows.select(value.alias("value"), ordinal).where("value is not null").groupBy("value").agg(F.min(ordinal).alias(ordinal))


def labelled(rows: DataFrame, category: str, value: str, canonical) -> tuple[DataFrame, DataFrame]:
    """Distinct (category, value) in canonical form, and one row with the number of invalid input rows."""
    c = canonical(F.col(value))
    cat = F.trim(F.coalesce(F.col(category), F.lit("")))
    ok = (cat != "") & c.isNotNull() & (c != "")
    good = rows.where(ok).select(cat.alias("category"), c.alias("value")).distinct()
    return good, rows.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


def require_files(paths: list[str]) -> None:
    """Fails with the names of all files that are missing."""
    missing = [p for p in paths if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(sorted(missing)))


def signature(inputs: list[str], config: dict) -> str:
    """A digest of a run's inputs and settings."""
    h = hashlib.sha256(json.dumps(config, sort_keys=True).encode())
    for path in sorted(inputs):
        with open(path, "rb") as f:
            h.update(hashlib.file_digest(f, "sha256").digest())
    return h.hexdigest()


def guard_output(folder: str, run: str, inputs: list[str]) -> None:
    """Refuses an output folder that holds another run's results or overlaps the inputs."""
    out = Path(folder).resolve()
    for p in inputs:
        if out == Path(p).resolve() or out in Path(p).resolve().parents:
            raise ValueError(f"output {folder} overlaps input {p}")
    mark = out / "run_signature.json"
    if mark.exists():
        if json.loads(mark.read_text())["signature"] != run:
            raise ValueError(f"{folder} holds another run's results")
    elif out.exists() and any(out.iterdir()):
        raise ValueError(f"{folder} isn't empty")
    out.mkdir(parents=True, exist_ok=True)
    mark.write_text(json.dumps({"signature": run}))


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows, columns in the order they are first seen, null where a part lacks one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fixed6(x: Column | str) -> Column:
    """Six decimals by the binary value, as C's printf; the JVM rounds the decimal text instead."""
    @F.pandas_udf("string")
    def render(v: pd.Series) -> pd.Series:
        return v.map(lambda d: None if pd.isna(d) else f"{d:.6f}")

    return render(x)


def write_scores(scores: DataFrame, path: str, floats: list[str], one_file: bool = False) -> None:
    """CSV with header, doubles at six decimals."""
    out = scores.withColumns({c: fixed6(c) for c in floats})
    (out.coalesce(1) if one_file else out).write.option("header", True).csv(path)


def write_json(path: str, value: dict) -> None:
    """Sorted keys; NaN and infinity are refused."""
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, allow_nan=False) + "\n")
