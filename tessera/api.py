"""The library's surface: list models, score one input, a table or a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.features import FeatureProvider
from tessera.operators import scoring
from tessera.sources import tables

#: Columns of the batch result that are written at six decimals.
FLOATS = [f"best_{c}" for c in ("score", "threshold", "margin", "property_score", "structure_score")] + [f"auxiliary_{c}" for c in ("score", "threshold", "margin")]


def available_models(folder: str, role: str | None = None) -> list[str]:
    """Ids of the models defined in a folder, in order; of one role, if given."""
    return [m.model_id for m in scoring.load_models(folder) if role in (None, m.role)]


def model_labels(folder: str) -> list[dict[str, str]]:
    """id, category and role of all models; those without a role of their own are hidden."""
    return [{"model_id": m.model_id, "category": m.category, "role": m.role or "hidden"} for m in scoring.load_models(folder)]


def select_models(models: list[scoring.Model], ids: list[str] | None) -> list[scoring.Model]:
    """The models of these ids in this order, each once; all public ones without ids; an unknown id is an error."""
    if not ids:
        return [m for m in models if m.role != "hidden"]
    known = {m.model_id: m for m in models}
    if missing := [i for i in ids if i not in known]:
        raise ValueError(f"unknown models: {missing}")
    return [known[i] for i in dict.fromkeys(ids)]


def score_table(rows: DataFrame, models: list[scoring.Model], provider: FeatureProvider, calibration: dict[str, float] | None = None) -> DataFrame:
    """One roll-up row for each entity the provider makes of rows."""
    scores = scoring.score_all(provider.entities(rows), models, "entity_id", F.col("valid"))
    return scoring.roll_up(scoring.specificity(scores, calibration or {}))


def score_file(spark: SparkSession, source: str, target: str, models: list[scoring.Model], provider_of, column: str | None = None, calibration: dict[str, float] | None = None) -> None:
    """Reads a delimited file, scores the input column, and writes all input columns with the roll-up, rows in input order.

    provider_of makes a provider from (id column, input column).
    """
    given = tables.read_delimited(spark, source)
    name = tables.resolve_column(given.columns, column)
    rows = given.withColumn("__row", F.monotonically_increasing_id())
    made = score_table(rows.withColumn("__category", F.lit("")), models, provider_of("__row", name), calibration)
    clash = {c: f"result_{c}" for c in made.columns if c in given.columns}
    made = made.withColumnsRenamed(clash).withColumnRenamed("entity_id", "__row")
    out = rows.join(made, "__row", "left").orderBy("__row").drop("__row")
    tables.write_scores(out, target, [clash.get(c, c) for c in FLOATS])


def _one_row(spark: SparkSession, value: str, provider_of) -> DataFrame:
    if value is None:
        raise TypeError("no input to score")
    return provider_of("__row", "__value").entities(spark.createDataFrame([(0, value, "")], "__row long, __value string, __category string"))


def score_all(spark: SparkSession, value: str, models: list[scoring.Model], provider_of) -> list[dict]:
    """All models' results for one input, best first; None is an error, an invalid input a result."""
    rows = scoring.ranked(scoring.score_all(_one_row(spark, value, provider_of), models, "entity_id", F.col("valid")))
    return [r.asDict(recursive=True) for r in rows.orderBy("score_rank").collect()]


def score(spark: SparkSession, value: str, model: scoring.Model, provider_of) -> float | None:
    """One model's score of one input; None where the input is invalid."""
    got = score_all(spark, value, [model], provider_of)[0]
    return got["score"] if got["valid"] else None


def category_scorers(spark: SparkSession, models: list[scoring.Model], provider_of) -> dict[str, object]:
    """For each public model's category a function from an input to its score."""
    return {m.category: (lambda value, m=m: score(spark, value, m, provider_of)) for m in select_models(models, None)}


def self_test(spark: SparkSession, models: list[scoring.Model], provider_of, probe: str = "probe text 1") -> list[str]:
    """What is wrong with the installed models: none, repeated ids, or results of a probe that aren't whole."""
    ids = [m.model_id for m in models]
    wrong = ([] if models else ["no models"]) + [f"repeated id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in score_all(spark, probe, models, provider_of) if models else []:
        if not r["valid"] or not r["decision"] or abs(r["score"] - r["threshold"] - r["margin"]) > 1e-9:
            wrong.append(f"{r['model_id']} gives no whole result")
    return wrong


def details(row: dict, model: scoring.Model, spark: SparkSession, valid: Column | None = None) -> dict:
    """Score, parts, decision and matched patterns of one entity given as a dict of its features."""
    frame = spark.createDataFrame([{"entity_id": 0, **row}])
    return scoring.score_all(frame, [model], "entity_id", valid).first().asDict(recursive=True)
