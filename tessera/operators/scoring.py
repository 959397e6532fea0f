"""Model definitions as column expressions, their fan-out over entities, and the roll-up.

A model is a small driver-side object; `score` turns it into one expression that
whole-stage code generation covers.  All models of a registry are evaluated in one
projection as an array of structs, so an entity's features are read once; only
then are the structs exploded.  Matched patterns enter as boolean columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.sources.tables import fixed6

INVALID_SCORE = -1e9


@dataclass(frozen=True)
class Model:
    """What every model has.  role: product, auxiliary or hidden."""

    model_id: str
    category: str
    threshold: float
    role: str = "product"

    def parts(self) -> tuple[Column, Column, Column]:
        """score, property score and structure score."""
        raise NotImplementedError

    def matched(self) -> Column:
        return F.array().cast("array<string>")


def _matched(weights: dict[str, float]) -> Column:
    if not weights:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in weights))))


def _fraction(weights: dict[str, float]) -> Column:
    """The matched patterns' share of all weight; 0 without weights."""
    total = sum(weights.values()) or 1.0
    hits = F.lit(0.0)
    for name, w in weights.items():
        hits = hits + F.when(F.col(name), F.lit(float(w))).otherwise(F.lit(0.0))
    return hits / F.lit(float(total))


@dataclass(frozen=True)
class RangeMotif(Model):
    """The share of properties inside their ranges (ends included), blended with the share of matched pattern weight."""

    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=dict)
    weight: float = 0.5

    def parts(self) -> tuple[Column, Column, Column]:
        inside = F.lit(0.0)
        for name, (low, high) in self.ranges.items():
            inside = inside + F.when(S.as_double(F.col(name)).between(float(low), float(high)), F.lit(1.0)).otherwise(F.lit(0.0))
        prop = inside / F.lit(float(len(self.ranges))) if self.ranges else F.lit(0.0)
        structure = _fraction(self.patterns)
        return F.lit(self.weight) * prop + F.lit(1 - self.weight) * structure, prop, structure

    def matched(self) -> Column:
        return _matched(self.patterns)


@dataclass(frozen=True)
class NetworkRangeMotif(RangeMotif):
    """A range-motif model blended with the weight of the fragments an entity has (array column `fragments`)."""

    network: dict[str, float] = field(default_factory=dict)
    base_weight: float = 0.5
    fragments: str = "fragments"

    def parts(self) -> tuple[Column, Column, Column]:
        base, prop, structure = super().parts()
        total = sum(self.network.values()) or 1.0
        hits = F.lit(0.0)
        for name, w in self.network.items():
            hits = hits + F.when(F.array_contains(self.fragments, name), F.lit(float(w))).otherwise(F.lit(0.0))
        net = hits / F.lit(float(total))
        b, w = self.base_weight, self.weight
        blended = (F.lit(b * (1 - w)) * structure + F.lit(1 - b) * net) / F.lit(max(b * (1 - w) + (1 - b), 1e-12))
        return F.lit(b) * base + F.lit(1 - b) * net, prop, blended

    def matched(self) -> Column:
        has = F.array_compact(F.array(*(F.when(F.array_contains(self.fragments, n), F.lit(f"network:{n}")) for n in sorted(self.network)))) if self.network else F.array().cast("array<string>")
        return F.concat(super().matched(), has)


@dataclass(frozen=True)
class GaussianAlerts(Model):
    """Weighted geometric mean of Gaussian desirabilities times a penalty for each alert, to a power."""

    gaussians: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # mean, deviation, weight
    alerts: tuple[str, ...] = ()
    base: float = 0.5
    alert_weight: float = 1.0
    gamma: float = 1.0

    def parts(self) -> tuple[Column, Column, Column]:
        total = sum(w for _, _, w in self.gaussians.values()) or 1.0
        logs = F.lit(0.0)
        for name, (mean, deviation, w) in self.gaussians.items():
            logs = logs + F.lit(float(w)) * F.ln(F.greatest(S.gaussian(F.col(name), mean, deviation), F.lit(1e-300)))
        prop = F.exp(logs / F.lit(float(total)))
        n = F.lit(0.0)
        for name in self.alerts:
            n = n + F.when(F.col(name), F.lit(1.0)).otherwise(F.lit(0.0))
        structure = F.pow(F.lit(self.base), F.lit(self.alert_weight) * n)
        return F.pow(S.clip(prop * structure, 1e-12, 1.0), F.lit(self.gamma)), prop, structure

    def matched(self) -> Column:
        return _matched(dict.fromkeys(self.alerts, 1.0))


@dataclass(frozen=True)
class HistogramPpv(Model):
    """Binned properties' mean positive predictive value, blended with core and side-chain patterns.

    property: pos / (pos + neg) of the value's bin, ends clamped.  structure: the largest
    weight of the core patterns (boolean columns) whose size is within 5 of the core's,
    0.10 for none, 0.05 without a core; and the side patterns' weight times the share of
    the size outside the core, through a sigmoid.
    """

    edges: dict[str, list[float]] = field(default_factory=dict)
    positive: dict[str, list[float]] = field(default_factory=dict)
    negative: dict[str, list[float]] = field(default_factory=dict)
    property_weight: float = 1.0
    structure_weight: float = 0.0
    cores: dict[str, tuple[float, float]] = field(default_factory=dict)  # weight, size
    sides: dict[str, float] = field(default_factory=dict)
    core_weight: float = 0.5
    core_size: str = "core_size"  # null without a core
    size: str = "size"

    def parts(self) -> tuple[Column, Column, Column]:
        total = F.lit(0.0)
        for name, edges in self.edges.items():
            ppv = [p / (p + n) if p + n > 1e-10 else 0.0 for p, n in zip(self.positive[name], self.negative[name], strict=True)]
            x, value = S.as_double(F.col(name)), F.lit(ppv[-1])
            for k in range(len(ppv) - 2, -1, -1):
                value = F.when(x < F.lit(float(edges[k + 1])), F.lit(ppv[k])).otherwise(value)
            total = total + value
        prop = total / F.lit(float(len(self.edges) or 1))
        structure = self._structure() if self.structure_weight else F.lit(0.0)
        return F.lit(self.property_weight) * prop + F.lit(self.structure_weight) * structure, prop, structure

    def _structure(self) -> Column:
        own, whole = F.col(self.core_size).cast("double"), F.col(self.size).cast("double")
        fits = [F.when(F.col(n) & (F.abs(own - F.lit(float(atoms))) <= 5), F.lit(float(w))) for n, (w, atoms) in self.cores.items()]
        best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("double")
        core = F.when(own.isNull(), F.lit(0.05)).otherwise(F.coalesce(best, F.lit(0.10)))
        hits = F.lit(0.0)
        for name, w in self.sides.items():
            hits = hits + F.when(F.col(name), F.lit(float(w))).otherwise(F.lit(0.0))
        outside = F.greatest(F.lit(0.0), whole - F.coalesce(own, F.lit(0.0))) / (whole + F.lit(1e-9))
        side = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-5.0) * (hits * outside - F.lit(0.25))))
        return F.lit(self.core_weight) * core + F.lit(1 - self.core_weight) * side


@dataclass(frozen=True)
class HalfGaussianSimilarity(Model):
    """Half-Gaussian property mean, group lookup, motif fraction and mean similarity as a weighted geometric mean.

    weights: property, group, motif, similarity; the structure score is the last three's,
    their weights scaled to 1.
    """

    gaussians: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # mean, deviation below, above
    group: str = "group_key"
    group_scores: dict[str, float] = field(default_factory=dict)
    group_default: float = 0.1
    motifs: dict[str, float] = field(default_factory=dict)
    similarities: tuple[str, ...] = ("max_similarity",)
    weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)

    def parts(self) -> tuple[Column, Column, Column]:
        logs = F.lit(0.0)
        for name, (mean, low, high) in self.gaussians.items():
            logs = logs + F.ln(S.half_gaussian(F.col(name), mean, low, high))
        prop = F.exp(logs / F.lit(float(len(self.gaussians) or 1)))
        found = F.lit(None).cast("double")
        for key, value in self.group_scores.items():
            found = F.when(F.col(self.group) == key, F.lit(float(value))).otherwise(found)
        group = F.coalesce(found, F.when(F.coalesce(F.col(self.group), F.lit("")) != "", F.lit(self.group_default)).otherwise(F.lit(0.0)))
        motif = F.least(_fraction(self.motifs), F.lit(1.0))
        near = sum((S.as_double(F.col(c)) for c in self.similarities), F.lit(0.0)) / F.lit(float(len(self.similarities)))
        log = lambda w, part: F.lit(float(w)) * F.ln(F.greatest(part, F.lit(1e-6)))
        outer = sum(self.weights[1:]) or 1.0
        structure = F.exp(sum((log(w / outer, x) for w, x in zip(self.weights[1:], (group, motif, near), strict=True)), F.lit(0.0)))
        score = F.exp(sum((log(w, x) for w, x in zip(self.weights, (prop, group, motif, near), strict=True)), F.lit(0.0)))
        return score, prop, structure

    def matched(self) -> Column:
        return _matched(self.motifs)


MODEL_TYPES = {"range_motif": RangeMotif, "network_range_motif": NetworkRangeMotif, "gaussian_alerts": GaussianAlerts, "histogram_ppv": HistogramPpv, "half_gaussian_similarity": HalfGaussianSimilarity}


def load_models(folder: str) -> list[Model]:
    """All JSON model definitions of a folder by name; `model_type` picks the class."""
    out = []
    for path in sorted(Path(folder).glob("*.json")):
        known = json.loads(path.read_text())
        kind = known.pop("model_type", None)
        if kind not in MODEL_TYPES:
            raise ValueError(f"unknown model type {kind!r} in {path.name}")
        if "ranges" in known:
            known["ranges"] = {k: tuple(v) for k, v in known["ranges"].items()}
        out.append(MODEL_TYPES[kind](**known))
    return out


def _struct(model: Model, order: int, valid: Column) -> Column:
    score, prop, structure = model.parts()
    bad = F.lit(INVALID_SCORE)
    value = F.when(valid, score).otherwise(bad)
    return F.struct(
        F.lit(model.model_id).alias("model_id"), F.lit(model.category).alias("category"), F.lit(model.role).alias("role"), F.lit(order).alias("release_order"), valid.alias("valid"),
        value.alias("score"), F.lit(float(model.threshold)).alias("threshold"), F.when(valid, score - F.lit(float(model.threshold))).otherwise(bad).alias("margin"),
        F.when(valid, prop).otherwise(F.lit(0.0)).alias("property_score"), F.when(valid, structure).otherwise(F.lit(0.0)).alias("structure_score"),
        F.when(~valid, F.lit("invalid input")).otherwise(S.decision(model.category, score, model.threshold)).alias("decision"),
        F.when(valid, model.matched()).otherwise(F.array().cast("array<string>")).alias("matched_patterns"),
    )


def score_all(entities: DataFrame, models: list[Model], entity_id: str, valid: Column | None = None) -> DataFrame:
    """One row for each entity and model, all models in one pass; repeated model ids are taken once."""
    seen = list({m.model_id: m for m in models}.values())
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    structs = F.array(*(_struct(m, k, ok) for k, m in enumerate(seen)))
    return entities.select(F.col(entity_id).alias("entity_id"), F.explode(structs).alias("s")).select("entity_id", "s.*")


def ranked(scores: DataFrame, within_role: bool = False) -> DataFrame:
    """Rank of each result of an entity: valid first, then score, then margin; ties keep the release order."""
    keys = ["entity_id", "role"] if within_role else ["entity_id"]
    order = W.partitionBy(*keys).orderBy(F.desc("valid"), F.desc("score"), F.desc("margin"), "release_order")
    return scores.withColumn("score_rank", F.row_number().over(order))


def specificity(scores: DataFrame, calibration: dict[str, float]) -> DataFrame:
    """unavailable, below, high_specificity or shared, tested in this order."""
    strict = F.lit(None).cast("double")
    for model_id, threshold in calibration.items():
        strict = F.when(F.col("model_id") == model_id, F.lit(float(threshold))).otherwise(strict)
    status = F.when(~F.col("valid") | strict.isNull(), "unavailable").when(F.col("score") < F.col("threshold"), "below").when(F.col("score") >= strict, "high_specificity").otherwise("shared")
    return scores.withColumn("specificity", status)


_BEST = ("category", "score", "threshold", "margin", "property_score", "structure_score", "decision")
_AUXILIARY = ("model_id", "category", "score", "threshold", "margin", "decision")


def roll_up(scores: DataFrame, role: str = "product") -> DataFrame:
    """Per entity 18 columns: the best result, numbers of positive and high-specificity products, the representative, the auxiliary result.

    scores: with specificity.  The best is the best valid product, else the best valid
    result of any role; without one its columns are null, but for the decision
    'invalid input' and best_valid.  The representative is the one product of high
    specificity, else 'unresolved'.  An invalid auxiliary result has neither score nor
    margin.
    """
    own = (F.col("role") == role) & F.col("valid")
    strict = own & (F.col("specificity") == "high_specificity")
    key = F.struct(F.col("valid").cast("int"), own.cast("int").alias("own"), "score", "margin", (-F.col("release_order")).alias("o"))
    n_strict = F.count_if(strict)
    helper = (F.col("role") == "auxiliary")
    rows = scores.groupBy("entity_id").agg(
        F.max_by(F.struct("valid", *_BEST), key).alias("b"),
        F.count_if(own & (F.col("score") >= F.col("threshold"))).alias("product_positive_count"),
        n_strict.alias("product_high_specificity_count"),
        F.when(n_strict == 1, F.max(F.when(strict, F.col("category")))).otherwise(F.lit("unresolved")).alias("representative"),
        F.min_by(F.when(helper, F.struct("valid", *_AUXILIARY)), F.when(helper, F.col("release_order"))).alias("a"),
    )
    valid = F.col("b.valid")
    best = [(F.when(valid, F.col(f"b.{c}")).otherwise(F.lit("invalid input")) if c == "decision" else F.when(valid, F.col(f"b.{c}"))).alias(f"best_{c}") for c in _BEST]
    side = [(F.when(F.col("a.valid"), F.col(f"a.{c}")) if c in ("score", "margin") else F.col(f"a.{c}")).alias(f"auxiliary_{c}") for c in _AUXILIARY]
    return rows.select("entity_id", *best, valid.alias("best_valid"), "product_positive_count", "product_high_specificity_count", "representative", *side, F.col("a.valid").alias("auxiliary_valid"))


def top_categories(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k best product categories of each entity as one text of category:score, best first."""
    rows = ranked(scores.where("role = 'product' and valid"), True).where(F.col("score_rank") <= k)
    named = F.concat_ws(":", "category", fixed6("score"))
    return rows.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("score_rank", named.alias("x")))), lambda x: x["x"]), "; ").alias("top_categories"))


def related_support(scores: DataFrame, related: list[str]) -> DataFrame:
    """The valid results of an entity's related models, ordered by score, then margin."""
    order = W.partitionBy("entity_id").orderBy(F.desc("score"), F.desc("margin"), "release_order")
    return scores.where(F.col("valid") & F.col("model_id").isin(related)).withColumn("place", F.row_number().over(order))


def evidence(candidates: DataFrame, similarity: str = "similarity", motif_hits: str = "motif_hits", motifs: str = "motifs") -> DataFrame:
    """Evidence-family score: 0.7 of the similarity and 0.3 of the motif fraction."""
    part = F.col(motif_hits).cast("double") / F.greatest(F.col(motifs), F.lit(1))
    return candidates.withColumn("evidence_score", F.lit(0.7) * F.col(similarity) + F.lit(0.3) * part)
