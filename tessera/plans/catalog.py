"""The library's queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.features import NumericFeatures
from tessera.functions import scalar as S
from tessera.operators import metrics, sampling, scoring, validation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a query; doubles are compared at `digits` decimals, as sums come in any order."""
    names = doubles.split()

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), digits) for c in names}) if names else df

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in names)}) FROM ({sql}) AS q" if names else sql
        return run

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART = NumericFeatures("p_partkey", "p_type", ["p_size", "p_retailprice"], {"has_red": "p_name like '%red%'", "has_bolt": "p_name like '%bolt%'", "has_ring": "p_name like '%ring%'", "is_small": "p_size < 10"})
PART_SQL = """(SELECT p_partkey AS entity_id, p_type AS category, CAST(p_size AS DOUBLE) AS p_size, p_retailprice,
  p_name LIKE '%red%' AS has_red, p_name LIKE '%bolt%' AS has_bolt, p_name LIKE '%ring%' AS has_ring, p_size < 10 AS is_small,
  list_filter([CASE WHEN p_name LIKE '%red%' THEN 'has_red' END, CASE WHEN p_name LIKE '%bolt%' THEN 'has_bolt' END, CASE WHEN p_name LIKE '%ring%' THEN 'has_ring' END, CASE WHEN p_size < 10 THEN 'is_small' END], lambda x: x IS NOT NULL) AS features
  FROM part)"""


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PART.entities(t(spark, sf_dir, "part"))


RANGE = scoring.RangeMotif("range", "economy", 0.6, ranges={"p_size": (5, 25), "p_retailprice": (905, 960)}, patterns={"has_red": 1.5, "has_bolt": 0.5}, weight=0.55)
NETWORK = scoring.NetworkRangeMotif("network", "promo", 0.5, ranges={"p_size": (10, 40)}, patterns={"has_ring": 1.0}, weight=0.4, network={"has_red": 0.3, "is_small": 0.9}, base_weight=0.7, fragments="features")
GAUSS = scoring.GaussianAlerts("gaussian", "small", 0.3, gaussians={"p_size": (20, 12, 1.0), "p_retailprice": (940, 30, 2.0)}, alerts=("has_bolt", "has_ring"), base=0.7, alert_weight=1.5, gamma=0.8)
PPV = scoring.HistogramPpv("ppv", "large", 0.5, role="auxiliary", edges={"p_size": [1, 10, 20, 30, 50]}, positive={"p_size": [4, 3, 2, 1]}, negative={"p_size": [1, 2, 2, 0]})
MODELS: list[scoring.Model] = [RANGE, NETWORK, GAUSS, PPV]
CALIBRATION = {"range": 0.8, "network": 0.4, "gaussian": 0.6}

_RANGE_PROP = "((CASE WHEN p_size BETWEEN 5 AND 25 THEN 1e0 ELSE 0e0 END + CASE WHEN p_retailprice BETWEEN 905 AND 960 THEN 1e0 ELSE 0e0 END) / 2e0)"
_RANGE_STRUCT = "((CASE WHEN has_red THEN 1.5e0 ELSE 0e0 END + CASE WHEN has_bolt THEN 0.5e0 ELSE 0e0 END) / 2e0)"
_RANGE = f"(0.55e0 * {_RANGE_PROP} + (1e0 - 0.55e0) * {_RANGE_STRUCT})"
_NET = "((CASE WHEN has_red THEN 0.3e0 ELSE 0e0 END + CASE WHEN is_small THEN 0.9e0 ELSE 0e0 END) / 1.2e0)"
_NET_PROP, _NET_STRUCT = "(CASE WHEN p_size BETWEEN 10 AND 40 THEN 1e0 ELSE 0e0 END)", "(CASE WHEN has_ring THEN 1e0 ELSE 0e0 END)"
_NETWORK = f"(0.7e0 * (0.4e0 * {_NET_PROP} + 0.6e0 * {_NET_STRUCT}) + 0.3e0 * {_NET})"
_GAUSS_PROP = "exp((1e0 * (-0.5e0 * power((p_size - 20e0) / 12e0, 2)) + 2e0 * (-0.5e0 * power((p_retailprice - 940e0) / 30e0, 2))) / 3e0)"
_GAUSS_STRUCT = "power(0.7e0, 1.5e0 * (CASE WHEN has_bolt THEN 1 ELSE 0 END + CASE WHEN has_ring THEN 1 ELSE 0 END))"
_GAUSS = f"power(least(greatest({_GAUSS_PROP} * {_GAUSS_STRUCT}, 1e-12), 1e0), 0.8e0)"
_PPV = "(CASE WHEN p_size < 10 THEN 0.8e0 WHEN p_size < 20 THEN 0.6e0 WHEN p_size < 30 THEN 0.5e0 ELSE 1e0 END)"


def _score_sql(model: str, category: str, threshold: float, score: str, prop: str, structure: str) -> str:
    return f"""SELECT entity_id, '{model}' AS model_id, score, score - {threshold}e0 AS margin, prop AS property_score, structure AS structure_score,
      CASE WHEN round(score, 9) >= {threshold}e0 THEN 'likely {category}' ELSE 'unlikely {category}' END AS decision
      FROM (SELECT entity_id, {score} AS score, {prop} AS prop, {structure} AS structure FROM {PART_SQL} AS p) AS s"""


def _one(spark: SparkSession, sf_dir: str, model: scoring.Model) -> DataFrame:
    return scoring.score_all(part(spark, sf_dir), [model], "entity_id").select("entity_id", "model_id", "score", "margin", "property_score", "structure_score", "decision")


_SCORE = "score margin property_score structure_score"


@query(_score_sql("range", "economy", 0.6, _RANGE, _RANGE_PROP, _RANGE_STRUCT), _SCORE)
def range_motif_score(spark, d):
    return _one(spark, d, RANGE)


@query(_score_sql("network", "promo", 0.5, _NETWORK, _NET_PROP, f"((0.42e0 * {_NET_STRUCT} + 0.3e0 * {_NET}) / 0.72e0)"), _SCORE)
def network_score(spark, d):
    return _one(spark, d, NETWORK)


@query(_score_sql("gaussian", "small", 0.3, _GAUSS, _GAUSS_PROP, _GAUSS_STRUCT), _SCORE)
def gaussian_alert_score(spark, d):
    return _one(spark, d, GAUSS)


@query(_score_sql("ppv", "large", 0.5, _PPV, _PPV, "0e0"), _SCORE)
def histogram_ppv_score(spark, d):
    return _one(spark, d, PPV)


CORED = scoring.HistogramPpv("cored", "large", 0.5, edges={"p_size": [1, 10, 20, 30, 50]}, positive={"p_size": [4, 3, 2, 1]}, negative={"p_size": [1, 2, 2, 0]}, property_weight=0.6, structure_weight=0.4, cores={"has_red": (0.8, 10), "has_ring": (0.6, 30)}, sides={"has_bolt": 0.7, "is_small": 0.4}, core_weight=0.3)
_OWN = "(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END)"
_CORE = f"(CASE WHEN {_OWN} IS NULL THEN 0.05e0 ELSE coalesce(greatest(CASE WHEN has_red AND abs({_OWN} - 10) <= 5 THEN 0.8e0 END, CASE WHEN has_ring AND abs({_OWN} - 30) <= 5 THEN 0.6e0 END), 0.1e0) END)"
_SIDE = f"(1e0 / (1e0 + exp(-5e0 * ((CASE WHEN has_bolt THEN 0.7e0 ELSE 0e0 END + CASE WHEN is_small THEN 0.4e0 ELSE 0e0 END) * greatest(0e0, p_size + 10 - coalesce({_OWN}, 0)) / (p_size + 10 + 1e-9) - 0.25e0))))"
_CORED = f"(0.3e0 * {_CORE} + 0.7e0 * {_SIDE})"


@query(_score_sql("cored", "large", 0.5, f"(0.6e0 * {_PPV} + 0.4e0 * {_CORED})", _PPV, _CORED), _SCORE)
def core_side_score(spark, d):
    rows = part(spark, d).withColumns({"core_size": F.when(F.col("p_size") % 3 != 0, F.col("p_size")), "size": F.col("p_size") + 10})
    return scoring.score_all(rows, [CORED], "entity_id").select("entity_id", "model_id", "score", "margin", "property_score", "structure_score", "decision")


HALF = scoring.HalfGaussianSimilarity("half", "medium", 0.4, gaussians={"p_size": (25, 10, 20), "p_retailprice": (950, 40, 20)}, group="group_key", group_scores={"ECONOMY": 0.9, "SMALL": 0.4}, group_default=0.2, motifs={"has_red": 1.0, "has_ring": 1.0}, similarities=("near", "nearer", "far"), weights=(0.4, 0.2, 0.1, 0.3))
_HALF_PROP = "exp((ln(greatest(exp(-0.5e0 * power((p_size - 25e0) / CASE WHEN p_size < 25 THEN 10e0 ELSE 20e0 END, 2)), 1e-12)) + ln(greatest(exp(-0.5e0 * power((p_retailprice - 950e0) / CASE WHEN p_retailprice < 950 THEN 40e0 ELSE 20e0 END, 2)), 1e-12))) / 2e0)"
_HALF_MOTIF = "((CASE WHEN has_red THEN 1e0 ELSE 0e0 END + CASE WHEN has_ring THEN 1e0 ELSE 0e0 END) / 2e0)"
_GROUP = "(CASE category WHEN 'ECONOMY' THEN 0.9e0 WHEN 'SMALL' THEN 0.4e0 ELSE 0.2e0 END)"
_NEAR = "((p_size / 50e0 + p_retailprice / 2000e0 + 0.25e0) / 3e0)"
_HALF_OUTER = f"(0.2e0 * ln({_GROUP}) + 0.1e0 * ln(greatest({_HALF_MOTIF}, 1e-6)) + 0.3e0 * ln(greatest({_NEAR}, 1e-6)))"
_HALF = f"exp(0.4e0 * ln(greatest({_HALF_PROP}, 1e-6)) + {_HALF_OUTER})"


@query(_score_sql("half", "medium", 0.4, _HALF, _HALF_PROP, f"exp({_HALF_OUTER} / 0.6e0)"), _SCORE)
def half_gaussian_score(spark, d):
    rows = part(spark, d).withColumns({"near": F.col("p_size") / 50.0, "nearer": F.col("p_retailprice") / 2000.0, "far": F.lit(0.25)})
    return scoring.score_all(rows, [HALF], "entity_id").select("entity_id", "model_id", "score", "margin", "property_score", "structure_score", "decision")


@query(
    """SELECT entity_id, CASE WHEN a > 0 AND b > 0 THEN exp((ln(a) + ln(b)) / 2e0) ELSE 0e0 END AS quality, a AS size_part, b AS price_part FROM (
    SELECT entity_id, (0.1e0 + 2e0 * exp(1e0 - exp(-u) - u)) / 2.5e0 AS a, (0.05e0 + 1.5e0 * exp(1e0 - exp(-v) - v)) / 2e0 AS b
    FROM (SELECT p_partkey AS entity_id, (p_size - 20e0) / 10e0 AS u, (p_retailprice - 950e0) / 25e0 AS v FROM part) AS x) AS y""",
    "quality size_part price_part",
)
def published_quality_score(spark, d):
    parts = part(spark, d).select("entity_id", S.double_exponential(F.col("p_size"), 0.1, 2, 20, 10, 2.5).alias("size_part"), S.double_exponential(F.col("p_retailprice"), 0.05, 1.5, 950, 25, 2).alias("price_part"))
    return parts.select("entity_id", S.geometric_mean([F.col("size_part"), F.col("price_part")]).alias("quality"), "size_part", "price_part")


_ALL_SQL = f"""(SELECT *, CASE WHEN valid AND round(score, 9) >= threshold THEN 1 ELSE 0 END AS positive FROM (
  SELECT entity_id, valid, m.model_id, m.category, m.role, m.o AS release_order, m.threshold,
    CASE WHEN valid THEN CASE m.o WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END ELSE -1e9 END AS score,
    CASE m.o WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE s3 END AS property_score, CASE m.o WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE 0e0 END AS structure_score
  FROM (SELECT entity_id, p_size > 3 AS valid, {_RANGE} AS s0, {_NETWORK} AS s1, {_GAUSS} AS s2, {_PPV} AS s3, {_RANGE_PROP} AS p0, {_NET_PROP} AS p1, {_GAUSS_PROP} AS p2, {_RANGE_STRUCT} AS t0, ((0.42e0 * {_NET_STRUCT} + 0.3e0 * {_NET}) / 0.72e0) AS t1, {_GAUSS_STRUCT} AS t2 FROM {PART_SQL} AS p) AS x
  CROSS JOIN (VALUES ('range', 'economy', 'product', 0, 0.6e0, 0.8e0), ('network', 'promo', 'product', 1, 0.5e0, 0.4e0), ('gaussian', 'small', 'product', 2, 0.3e0, 0.6e0), ('ppv', 'large', 'auxiliary', 3, 0.5e0, NULL)) AS m(model_id, category, role, o, threshold, strict)) AS y)"""


def _all(spark, d):
    # entities are dealt before they are scored, by a fixed number: rows are a fraction of the scores', and what groups or ranks an entity's scores sends none
    entities = part(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity_id")
    # scores are cut at nine decimals, so that equal ones stay equal in any arithmetic
    rows = scoring.score_all(entities, MODELS, "entity_id", F.col("p_size") > 3)
    return rows.withColumn("score", F.round("score", 9)).withColumn("margin", F.when(F.col("valid"), F.round(F.col("score") - F.col("threshold"), 9)).otherwise(F.col("margin")))


@query(f"SELECT entity_id, valid, model_id, role, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY valid DESC, round(score, 9) DESC, CASE WHEN valid THEN round(round(score, 9) - threshold, 9) ELSE -1e9 END DESC, release_order) AS INTEGER) AS score_rank FROM {_ALL_SQL} AS a", "score")
def model_ranking(spark, d):
    return scoring.ranked(_all(spark, d)).select("entity_id", "valid", "model_id", "role", "score", "score_rank")


@query(f"SELECT entity_id, model_id, role, CAST(row_number() OVER (PARTITION BY entity_id, role ORDER BY valid DESC, round(score, 9) DESC, CASE WHEN valid THEN round(round(score, 9) - threshold, 9) ELSE -1e9 END DESC, release_order) AS INTEGER) AS score_rank FROM {_ALL_SQL} AS a")
def rank_within_role(spark, d):
    return scoring.ranked(_all(spark, d), True).select("entity_id", "model_id", "role", "score_rank")


_SPEC = f"""(SELECT *, CASE WHEN NOT valid OR strict IS NULL THEN 'unavailable' WHEN round(score, 9) < threshold THEN 'below' WHEN round(score, 9) >= strict THEN 'high_specificity' ELSE 'shared' END AS specificity
  FROM (SELECT a.*, CASE model_id WHEN 'range' THEN 0.8e0 WHEN 'network' THEN 0.4e0 WHEN 'gaussian' THEN 0.6e0 END AS strict FROM {_ALL_SQL} AS a) AS b)"""


@query(f"SELECT model_id, specificity, count(*) AS n FROM {_SPEC} AS s GROUP BY 1, 2")
def specificity_classes(spark, d):
    return scoring.specificity(_all(spark, d), CALIBRATION).groupBy("model_id", "specificity").agg(F.count("*").alias("n"))


@query(
    f"""SELECT entity_id, CASE WHEN b.valid THEN b.category END AS best_category, CASE WHEN b.valid THEN b.score END AS best_score, CASE WHEN b.valid THEN b.threshold END AS best_threshold, CASE WHEN b.valid THEN b.margin END AS best_margin,
  CASE WHEN b.valid THEN b.property_score END AS best_property_score, CASE WHEN b.valid THEN b.structure_score END AS best_structure_score, CASE WHEN b.valid THEN b.decision ELSE 'invalid input' END AS best_decision, b.valid AS best_valid,
  product_positive_count, product_high_specificity_count, representative, a.model_id AS auxiliary_model_id, a.category AS auxiliary_category, CASE WHEN a.valid THEN a.score END AS auxiliary_score, a.threshold AS auxiliary_threshold,
  CASE WHEN a.valid THEN a.margin END AS auxiliary_margin, a.decision AS auxiliary_decision, a.valid AS auxiliary_valid
  FROM (SELECT entity_id, arg_max(r, (CAST(valid AS INTEGER), CASE WHEN role = 'product' AND valid THEN 1 ELSE 0 END, r.score, r.margin, -release_order)) AS b, max(r) FILTER (role = 'auxiliary') AS a,
    count(*) FILTER (role = 'product' AND positive = 1) AS product_positive_count, count(*) FILTER (role = 'product' AND specificity = 'high_specificity') AS product_high_specificity_count,
    CASE WHEN count(*) FILTER (role = 'product' AND specificity = 'high_specificity') = 1 THEN max(category) FILTER (role = 'product' AND specificity = 'high_specificity') ELSE 'unresolved' END AS representative
    FROM (SELECT *, {{'valid': valid, 'model_id': model_id, 'category': category, 'score': round(score, 9), 'threshold': threshold, 'margin': CASE WHEN valid THEN round(round(score, 9) - threshold, 9) ELSE -1e9 END, 'property_score': property_score, 'structure_score': structure_score,
      'decision': CASE WHEN NOT valid THEN 'invalid input' WHEN positive = 1 THEN 'likely ' || category ELSE 'unlikely ' || category END}} AS r FROM {_SPEC} AS s) AS q GROUP BY entity_id) AS z""",
    "best_score best_threshold best_margin best_property_score best_structure_score auxiliary_score auxiliary_threshold auxiliary_margin",
)
def all_model_rollup(spark, d):
    return scoring.roll_up(scoring.specificity(_all(spark, d), CALIBRATION))


@query(f"""SELECT entity_id, string_agg(category || ':' || printf('%.6f', round(score, 9)), '; ' ORDER BY r) AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC, round(round(score, 9) - threshold, 9) DESC, release_order) AS r FROM {_ALL_SQL} AS a WHERE role = 'product' AND valid) AS b WHERE r <= 3 GROUP BY entity_id""")
def top_categories(spark, d):
    return scoring.top_categories(_all(spark, d), 3)


@query(f"SELECT entity_id, model_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC, round(round(score, 9) - threshold, 9) DESC, release_order) AS INTEGER) AS place FROM {_ALL_SQL} AS a WHERE valid AND model_id IN ('network', 'ppv')", "score")
def related_support(spark, d):
    return scoring.related_support(_all(spark, d), ["network", "ppv"]).select("entity_id", "model_id", "score", "place")


@query(
    """SELECT * FROM (SELECT doc_id, source, evidence_score, CAST(row_number() OVER (PARTITION BY lang ORDER BY evidence_score DESC, doc_id) AS INTEGER) AS place
    FROM (SELECT *, 0.7e0 * least(n_chars / 5000e0, 1e0) + 0.3e0 * (CAST((CASE WHEN text LIKE '%!%' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) AS DOUBLE) / 2) AS evidence_score FROM documents) AS x) AS y WHERE place <= 5""",
    "evidence_score",
)
def evidence_families(spark, d):
    docs = t(spark, d, "documents")
    rows = docs.select("doc_id", "source", "lang", F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("similarity"), (F.col("text").contains("!").cast("int") + F.col("text").rlike("[0-9]").cast("int")).alias("motif_hits"), F.lit(2).alias("motifs"))
    order = W.partitionBy("lang").orderBy(F.desc("evidence_score"), "doc_id")
    return scoring.evidence(rows).withColumn("place", F.row_number().over(order)).where("place <= 5").select("doc_id", "source", "evidence_score", "place")


# -- metrics ------------------------------------------------------------------------------------------------

SCORED = "(SELECT d.lang, d.source, d.doc_id, round(least(1e0, d.n_chars / 4000e0), 2) AS score, l.quality = 1 AS positive FROM documents d JOIN labels l USING (doc_id))"
_CURVE = f"""(SELECT *, sum(p) OVER dn AS tp, sum(n) OVER dn AS fp, sum(p) OVER al AS pos, sum(n) OVER al AS neg FROM (
  SELECT lang, score, CAST(count(*) FILTER (positive) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT positive) AS DOUBLE) AS n FROM {SCORED} AS s GROUP BY 1, 2) AS h
  WINDOW dn AS (PARTITION BY lang ORDER BY score DESC), al AS (PARTITION BY lang))"""
_RATES = f"""(SELECT *, (CASE WHEN pos > 0 THEN tp / pos ELSE 0 END + CASE WHEN neg > 0 THEN (neg - fp) / neg ELSE 0 END) / 2 AS ba,
  CASE WHEN (tp + fp) * pos * neg * (pos + neg - tp - fp) > 0 THEN (tp * (neg - fp) - fp * (pos - tp)) / sqrt((tp + fp) * pos * neg * (pos + neg - tp - fp)) ELSE 0 END AS mcc FROM {_CURVE} AS c)"""
#: and the double above all scores as a threshold that takes no row
_TRIED = f"(SELECT lang, score, ba, mcc FROM {_RATES} AS r UNION ALL SELECT lang, nextafter(max(score), CAST('Infinity' AS DOUBLE)), max(CASE WHEN neg > 0 THEN 0.5e0 ELSE 0e0 END), 0e0 FROM {_RATES} AS r GROUP BY lang)"
_BEST_KEY = "(round(ba, 12), round(mcc, 12), -abs(score - 0.5e0), -score)"


def scored(spark, d):
    docs, labels = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), t(spark, d, "labels")
    return docs.join(labels, "doc_id").select("lang", "source", "doc_id", F.round(F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)), 2).alias("score"), (F.col("quality") == 1).alias("positive"))


def hist(spark, d):
    return metrics.histogram(scored(spark, d), ["lang"])


@query(f"SELECT lang, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) ELSE 0 END AS auc FROM {_CURVE} AS c GROUP BY lang", "auc")
def roc_auc_by_group(spark, d):
    return metrics.roc_auc(hist(spark, d), ["lang"])


@query(f"SELECT lang, max(CASE WHEN pos > 0 AND neg > 0 THEN abs(tp / pos - fp / neg) ELSE 0 END) AS ks FROM {_CURVE} AS c GROUP BY lang", "ks")
def ks_by_group(spark, d):
    return metrics.ks_statistic(hist(spark, d), ["lang"])


@query(f"SELECT lang, sum(CASE WHEN pos > 0 THEN p / pos * tp / (tp + fp) ELSE 0 END) AS average_precision FROM {_CURVE} AS c GROUP BY lang", "average_precision")
def average_precision(spark, d):
    return metrics.average_precision(hist(spark, d), ["lang"])


@query(f"SELECT lang, arg_max(score, {_BEST_KEY}) AS threshold, max(ba) AS balanced_accuracy, arg_max(mcc, {_BEST_KEY}) AS mcc FROM {_TRIED} AS r GROUP BY lang", "threshold balanced_accuracy mcc")
def best_threshold(spark, d):
    return metrics.best_threshold(hist(spark, d), ["lang"])


@query(f"SELECT lang, CASE WHEN max(pos) = 0 OR max(neg) = 0 THEN 0.5e0 ELSE arg_max(score, (round(tp / pos - fp / neg, 12), score)) END AS threshold FROM {_CURVE} AS c GROUP BY lang", "threshold")
def roc_curve_threshold(spark, d):
    return metrics.first_best_threshold(hist(spark, d), ["lang"])


def _fpr_sql(cap: float) -> str:
    rates = f"(SELECT lang, score, CASE WHEN pos > 0 THEN tp / pos ELSE 0e0 END AS tpr, CASE WHEN neg > 0 THEN fp / neg ELSE 0e0 END AS fpr FROM {_CURVE} AS c)"
    return f"SELECT lang, coalesce(arg_max(score, (tpr, -score)) FILTER (fpr <= {cap}), nextafter(max(score), CAST('Infinity' AS DOUBLE))) AS threshold, coalesce(max(tpr) FILTER (fpr <= {cap}), 0e0) AS tpr FROM {rates} AS r GROUP BY lang"


@query(_fpr_sql(0.5), "threshold tpr")
def fpr_threshold(spark, d):
    return metrics.fpr_threshold(hist(spark, d), ["lang"], 0.5)


@query(_fpr_sql(0.01), "threshold tpr")
def strict_fpr_threshold(spark, d):
    return metrics.fpr_threshold(hist(spark, d), ["lang"], 0.01)


@query(
    f"""SELECT *, (sensitivity + specificity) / 2 AS balanced_accuracy FROM (SELECT lang, tp, fp, pos, neg, CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / pos ELSE 0 END AS sensitivity, CASE WHEN neg > 0 THEN CAST(neg - fp AS DOUBLE) / neg ELSE 0 END AS specificity,
    CASE WHEN CAST(tp + fp AS DOUBLE) * pos * neg * (pos + neg - tp - fp) > 0 THEN (CAST(tp AS DOUBLE) * (neg - fp) - CAST(fp AS DOUBLE) * (pos - tp)) / sqrt(CAST(tp + fp AS DOUBLE) * pos * neg * (pos + neg - tp - fp)) ELSE 0 END AS mcc
    FROM (SELECT lang, count(*) FILTER (positive AND score >= 0.4e0) AS tp, count(*) FILTER (NOT positive AND score >= 0.4e0) AS fp, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM {SCORED} AS s GROUP BY lang) AS x) AS y""",
    "sensitivity specificity mcc balanced_accuracy",
)
def binary_metrics(spark, d):
    return metrics.at_threshold(scored(spark, d), ["lang"], F.lit(0.4))


@query(
    f"""SELECT lang, arg_max(cut, (round(ba, 12), -cut)) AS threshold, max(ba) AS balanced_accuracy FROM (
    SELECT s.lang, cut, (CAST(count(*) FILTER (positive AND score >= cut) AS DOUBLE) / greatest(count(*) FILTER (positive), 1) + CAST(count(*) FILTER (NOT positive AND score < cut) AS DOUBLE) / greatest(count(*) FILTER (NOT positive), 1)) / 2 AS ba
    FROM {SCORED} AS s JOIN (SELECT DISTINCT lang, unnest(cuts) AS cut FROM (SELECT lang, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM {SCORED} AS z GROUP BY lang) AS q) AS c ON s.lang = c.lang GROUP BY 1, 2) AS g GROUP BY lang""",
    "threshold balanced_accuracy",
)
def decile_threshold(spark, d):
    return metrics.decile_threshold(scored(spark, d), ["lang"])


@query(
    f"""WITH e AS (SELECT lang, positive, score AS x, least(floor((score - -0.05e0) / (1.1e0 / 200)), 199) AS k FROM {SCORED} AS s WHERE score BETWEEN -0.05e0 AND 1.05e0),
    b AS (SELECT lang, positive, CASE WHEN x < k * (1.1e0 / 200) + -0.05e0 THEN k - 1 WHEN k < 199 AND x >= (k + 1) * (1.1e0 / 200) + -0.05e0 THEN k + 1 ELSE k END AS bin FROM e)
    SELECT lang, sum(least(p / greatest(tp, 1), n / greatest(tn, 1))) AS overlap FROM (SELECT *, sum(p) OVER (PARTITION BY lang) AS tp, sum(n) OVER (PARTITION BY lang) AS tn FROM (
    SELECT lang, bin, CAST(count(*) FILTER (positive) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT positive) AS DOUBLE) AS n FROM b GROUP BY 1, 2) AS h) AS w GROUP BY lang""",
    "overlap",
)
def histogram_overlap(spark, d):
    return metrics.histogram_overlap(scored(spark, d), ["lang"])


_KERNELS = f"""WITH h AS (SELECT lang, score AS x, CAST(count(*) FILTER (positive) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT positive) AS DOUBLE) AS n FROM {SCORED} AS s GROUP BY 1, 2),
    m AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS tn, sum(p * x) OVER w / sum(p) OVER w AS mp, sum(n * x) OVER w / sum(n) OVER w AS mn FROM h WINDOW w AS (PARTITION BY lang)),
    k AS (SELECT *, sqrt(sum(p * power(x - mp, 2)) OVER w / (tp - 1)) * power(tp, -0.2e0) AS hp, sqrt(sum(n * power(x - mn, 2)) OVER w / (tn - 1)) * power(tn, -0.2e0) AS hn FROM m WHERE tp > 1 AND tn > 1 WINDOW w AS (PARTITION BY lang)),
    d AS (SELECT lang, i, sum(p * exp(-0.5e0 * power((-0.05e0 + 1.1e0 * i / 1999e0 - x) / hp, 2))) AS a, sum(n * exp(-0.5e0 * power((-0.05e0 + 1.1e0 * i / 1999e0 - x) / hn, 2))) AS b FROM k, range(0, 2000) AS r(i) WHERE hp > 0 AND hn > 0 GROUP BY 1, 2),
    t AS (SELECT *, sum(a * CASE WHEN i IN (0, 1999) THEN 0.5e0 ELSE 1e0 END) OVER w AS sa, sum(b * CASE WHEN i IN (0, 1999) THEN 0.5e0 ELSE 1e0 END) OVER w AS sb FROM d WINDOW w AS (PARTITION BY lang))
    SELECT g.lang, coalesce(o, 0e0) AS overlap FROM (SELECT DISTINCT lang FROM h) AS g LEFT JOIN (SELECT lang, sum(least(a / sa, b / sb) * CASE WHEN i IN (0, 1999) THEN 0.5e0 ELSE 1e0 END) AS o FROM t GROUP BY 1) AS q USING (lang)"""


@query(_KERNELS, "overlap")
def kde_overlap(spark, d):
    return metrics.kde_overlap(scored(spark, d), ["lang"])


@query()
def bootstrap_auc(spark, d):
    return validation.bootstrap_auc(hist(spark, d), ["lang"], 1000, 7)


@query("SELECT p_type AS category, count(p_size) AS n, avg(p_size) AS mean, coalesce(stddev_samp(p_size), 0) AS sd, CAST(min(p_size) AS DOUBLE) AS least, quantile_cont(p_size, 0.25) AS q25, quantile_cont(p_size, 0.5) AS median, quantile_cont(p_size, 0.75) AS q75, CAST(max(p_size) AS DOUBLE) AS largest FROM part GROUP BY 1", "mean sd q25 median q75")
def summary_stats(spark, d):
    return metrics.summary(part(spark, d), ["category"], "p_size")


@query("SELECT category, avg(x) AS mean, greatest(coalesce(stddev_samp(x), 0), 1e-6) AS sd FROM (SELECT l_returnflag AS category, l_extendedprice AS x, quantile_cont(l_extendedprice, 0.05) OVER (PARTITION BY l_returnflag) AS a, quantile_cont(l_extendedprice, 0.95) OVER (PARTITION BY l_returnflag) AS b FROM lineitem) AS q WHERE x BETWEEN a AND b GROUP BY 1", "mean sd", digits=4)
def trimmed_moments(spark, d):
    return metrics.trimmed(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), "l_extendedprice"), ["category"], "l_extendedprice")


@query("SELECT category, max(m) AS mean, coalesce(avg(abs(x - m)) FILTER (x < m), 1) AS below, coalesce(avg(abs(x - m)) FILTER (x > m), 1) AS above FROM (SELECT p_type AS category, CAST(p_size AS DOUBLE) AS x, avg(p_size) OVER (PARTITION BY p_type) AS m FROM part) AS q GROUP BY 1", "mean below above")
def half_gaussian_fit(spark, d):
    return metrics.half_gaussian_fit(part(spark, d), ["category"], "p_size")


@query(
    f"""WITH s AS (SELECT p.category AS source, m.target, CASE m.target WHEN 'economy' THEN round({_RANGE}, 9) WHEN 'promo' THEN round({_NETWORK}, 9) ELSE round({_GAUSS}, 9) END AS score, m.threshold FROM {PART_SQL} AS p CROSS JOIN (VALUES ('economy', 0.6e0), ('promo', 0.5e0), ('small', 0.3e0)) AS m(target, threshold)),
    c AS (SELECT source, target, count(*) AS n, quantile_cont(score, 0.5) AS median, avg(score) AS mean, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75, avg(CASE WHEN score >= threshold THEN 1e0 ELSE 0e0 END) AS fraction_at_threshold FROM s GROUP BY 1, 2)
    SELECT *, median - foreign_median AS excess FROM (SELECT *, max(CASE WHEN source <> target THEN median END) OVER (PARTITION BY target) AS foreign_median FROM c) AS x""",
    "median mean q25 q75 fraction_at_threshold foreign_median excess",
)
def cross_category_matrix(spark, d):
    rows = part(spark, d)
    made = scoring.score_all(rows, MODELS[:3], "entity_id").select("entity_id", F.col("category").alias("target"), F.round("score", 9).alias("score"), "threshold")
    return metrics.cross_matrix(made.join(rows.select("entity_id", F.col("category").alias("source")), "entity_id"), "source", "target", "score", "threshold")


@query(f"SELECT lang, score, ((tp + 0.5e0) / (pos + 1)) / ((fp + 0.5e0) / (neg + 1)) AS tail_ratio FROM {_CURVE} AS c", "tail_ratio")
def tail_likelihood_ratio(spark, d):
    return metrics.tail_ratio(hist(spark, d), ["lang"])


@query(
    f"""WITH a AS (SELECT lang, max(pos) AS pos, max(neg) AS neg, sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) AS auc, max(abs(tp / pos - fp / neg)) AS ks, max(ba) AS ba, arg_max(score, (round(tp / pos - fp / neg, 12), score)) AS threshold FROM {_RATES} AS r GROUP BY lang),
    o AS ({SQL['histogram_overlap']})
    SELECT lang, CASE WHEN pos < 2 OR neg < 2 THEN 10e0 ELSE 2e0 * overlap + (1 - auc) + (1 - ba) + 0.5e0 * (1 - ks) + 0.2e0 * abs(threshold - 0.5e0) END AS objective FROM a JOIN o USING (lang)""",
    "objective",
    digits=4,
)
def grid_objective(spark, d):
    h, keys = hist(spark, d), ["lang"]
    rows = h.groupBy("lang").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    for part_of in (metrics.roc_auc(h, keys), metrics.ks_statistic(h, keys), metrics.first_best_threshold(h, keys), metrics.best_threshold(h, keys).select("lang", "balanced_accuracy"), metrics.histogram_overlap(scored(spark, d), keys)):
        rows = rows.join(part_of, keys)
    return rows.select("lang", metrics.objective(F.col("auc"), F.col("ks"), F.col("balanced_accuracy"), F.col("threshold"), F.col("overlap"), F.col("pos"), F.col("neg")).alias("objective"))


# -- sampling -----------------------------------------------------------------------------------------------

_FRACTION = "CAST(CAST(concat('0x', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616e0"


@query(f"SELECT doc_id, CASE WHEN x < 0.6e0 THEN 'train' WHEN x < 0.8e0 THEN 'validation' ELSE 'test' END AS split, x AS fraction FROM (SELECT doc_id, {_FRACTION} AS x FROM documents) AS q", "fraction", digits=12)
def hash_split(spark, d):
    key = F.col("doc_id").cast("string")
    return t(spark, d, "documents").select("doc_id", sampling.split_column(key).alias("split"), S.hash_fraction(key).alias("fraction"))


@query("SELECT source, CAST(concat('0x', substr(sha256(source), 1, 8)) AS BIGINT) % 5 AS bucket, CAST(concat('0x', substr(sha256(source), 1, 8)) AS BIGINT) AS seed, count(*) AS n FROM documents GROUP BY source")
def hash_bucket(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(S.hash_bucket(F.col("source"), 5).alias("bucket"), S.stable_seed(F.col("source")).alias("seed"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY sha256(concat('salt|', doc_id)), CAST(doc_id AS VARCHAR) LIMIT 50")
def hash_sample(spark, d):
    return sampling.hash_sample(t(spark, d, "documents").select("doc_id"), "doc_id", 50, "salt")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('cap|', doc_id)), CAST(doc_id AS VARCHAR)) AS r, (SELECT count(DISTINCT source) FROM documents) AS k FROM documents) AS q WHERE r <= ceil(100e0 / k)")
def sample_per_category(spark, d):
    return sampling.capped_per_category(t(spark, d, "documents").select("source", "doc_id"), "doc_id", "source", 100, "cap")


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_occurrence(spark, d):
    rows = t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    return sampling.first_occurrence(rows, ["h"], "doc_id")


@query("SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS seen_before FROM documents")
def seen_before(spark, d):
    rows = t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    return sampling.seen_before(rows, "h", "doc_id").select("doc_id", "seen_before")


@query("SELECT source, count(DISTINCT s) AS splits FROM (SELECT source, CASE WHEN x < 0.6e0 THEN 0 WHEN x < 0.8e0 THEN 1 ELSE 2 END AS s FROM (SELECT source, " + _FRACTION + " AS x FROM documents) AS q) AS r GROUP BY source HAVING count(DISTINCT s) > 1")
def split_leakage(spark, d):
    rows = t(spark, d, "documents").select("source", sampling.split_column(F.col("doc_id").cast("string")).alias("split"))
    return sampling.leaking_groups(rows, "source", "split")


@query(r"SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug, upper(substr(label, 1, 1)) || substr(label, 2) AS label FROM (SELECT *, replace(lower(p_type) || '_part', '_', ' ') AS label FROM part) AS q")
def slugs_and_labels(spark, d):
    return t(spark, d, "part").select("p_partkey", S.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), S.humanise(F.concat(F.lower("p_type"), F.lit("_part"))).alias("label"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS h FROM documents")
def canonical_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", S.sha_hex(S.canonical_text(F.col("text"))).alias("h"))
