"""Fitting, tuning, evaluating and promoting models; negative regimes; bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import similarity
from tessera.operators.patterns import reasons
from tessera.operators.sampling import hash_sample


def unpivot_properties(rows: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """keys, property and value for each numeric column, in one pass."""
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("value")) for p in props))).alias("s")).select(*keys, "s.property", "s.value")


def fit_properties(rows: DataFrame, props: list[str], positive: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """For each property: its KS statistic between the classes and the positives' quantile range."""
    long = unpivot_properties(rows, [positive], props)
    ks = M.ks_statistic(M.histogram(long, ["property"], "value", positive), ["property"])
    ends = long.where(F.col(positive)).groupBy("property").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("ends"))
    return ks.join(ends, "property").select("property", "ks", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def select_properties(fitted: DataFrame, cutoff: float, at_least: int = 1) -> list[str]:
    """Properties of KS >= cutoff; if none, the best `at_least` (ties: the last by name).  A handful of rows."""
    rows = sorted(fitted.collect(), key=lambda r: (r["ks"], r["property"]), reverse=True)
    return [r["property"] for r in rows if r["ks"] >= cutoff] or [r["property"] for r in rows[:at_least]]


def weight_grid(scored: DataFrame, keys: list[str], first: str, second: str, positive: str, steps: int = 20) -> DataFrame:
    """AUC and best threshold of w * first + (1 - w) * second for w = 0 .. 1; one pass over the rows for all weights."""
    w = F.explode(F.array(*(F.lit(k / steps) for k in range(steps + 1)))).alias("w")
    rows = scored.select(*keys, first, second, positive, w).withColumn("score", F.col("w") * F.col(first) + (1 - F.col("w")) * F.col(second))
    hist = M.histogram(rows, [*keys, "w"], "score", positive)
    return M.roc_auc(hist, [*keys, "w"]).join(M.best_threshold(hist, [*keys, "w"]), [*keys, "w"])


def best_weight(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The weight of most AUC, then balanced accuracy, the first of equals."""
    key = F.struct(F.round("auc", 12), F.round("balanced_accuracy", 12), -F.col("w"))
    return grid.groupBy(*keys).agg(F.max_by("w", key).alias("w"), F.max("auc").alias("auc")) if keys else grid.agg(F.max_by("w", key).alias("w"), F.max("auc").alias("auc"))


def folds_gate(deltas: DataFrame, keys: list[str], gain: str, original: str) -> DataFrame:
    """Promoted if the gain is positive in each fold, 0.02 on average, and the original score loses no more than 0.02 on average."""
    got = deltas.groupBy(*keys).agg(F.min(gain).alias("least_gain"), F.avg(gain).alias("mean_gain"), F.avg(original).alias("mean_original"))
    return got.withColumn("promoted", (F.col("least_gain") > 0) & (F.col("mean_gain") >= 0.02) & (F.col("mean_original") >= -0.02))


def promotion(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """All failed gates, in the order given, and whether none failed."""
    return rows.withColumn("failures", reasons(gates, in_order=True)).withColumn("promoted", F.col("failures") == "")


def negative_regimes(rows: DataFrame, target: Column, key: str, props: list[str], k: int, salt: str, features: str | None = None) -> DataFrame:
    """Negatives of a target by regime: all_other (hash sample), property_matched (nearest to the target's medians) and, with features, related_hard (most similar)."""
    own, other = rows.where(target), rows.where(~target)
    parts = [hash_sample(other, key, k, salt).select(key, F.lit("all_other").alias("regime"))]
    parts.append(similarity.matched_l2(other, own, key, props, k).select(key, F.lit("property_matched").alias("regime")))
    if features:
        near = similarity.max_similarity(other, own, key, key, features)
        parts.append(near.orderBy(F.desc("max_similarity"), key).limit(k).select(key, F.lit("related_hard").alias("regime")))
    return reduce(DataFrame.unionAll, parts)


def ablation(scored: DataFrame, keys: list[str], components: list[str], positive: str) -> DataFrame:
    """AUC, best threshold and its balanced accuracy of each score component."""
    long = unpivot_properties(scored, [*keys, positive], components).withColumnRenamed("property", "component").withColumnRenamed("value", "score")
    hist = M.histogram(long, [*keys, "component"], "score", positive)
    return M.roc_auc(hist, [*keys, "component"]).join(M.best_threshold(hist, [*keys, "component"]), [*keys, "component"])


def delta_to_baseline(rows: DataFrame, keys: list[str], variant: str, baseline: str, measures: list[str]) -> DataFrame:
    """Each variant's measures less the baseline's of the same keys."""
    base = rows.where(F.col(variant) == baseline).select(*keys, *(F.col(m).alias(f"__{m}") for m in measures))
    return rows.join(base, keys, "left").select(*keys, variant, *measures, *((F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in measures))


def decision_label(auc: Column, balanced: Column, positives: Column, released: Column) -> Column:
    """The decision on a built model; the first that holds, in this order."""
    strong, good = (auc >= 0.90) & (balanced >= 0.80), (auc >= 0.80) & (balanced >= 0.75)
    return (
        F.when(positives < 25, "insufficient_positive_examples").when(auc.isNull() | balanced.isNull(), "build_failed").when(F.coalesce(released, F.lit(False)), "existing_release_line")
        .when(strong & (positives >= 100), "strong_release_candidate").when(good & (positives >= 100), "release_candidate").when(auc >= 0.70, "experimental_revisit").otherwise("reject_for_now")
    )


def bootstrap_auc(hist: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """2.5, 50 and 97.5 % points of the AUC under stratified resampling.

    A replicate redraws each class's histogram by a multinomial; streams are seeded
    by group and replicate, so results don't depend on partitions.
    """
    import zlib

    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        p, n = pdf["p"].to_numpy(), pdf["n"].to_numpy()
        name = "|".join(str(pdf[k].iloc[0]) for k in keys)
        got = []
        for r in range(replicates if p.sum() and n.sum() else 0):
            rng = np.random.Generator(np.random.PCG64([seed, r, zlib.crc32(name.encode())]))
            a, b = rng.multinomial(p.sum(), p / p.sum()), rng.multinomial(n.sum(), n / n.sum())
            below = np.cumsum(b) - b
            got.append((a * (2 * below + b)).sum() / (2 * p.sum() * n.sum()))
        q = np.quantile(got, [0.025, 0.5, 0.975]) if got else [float("nan")] * 3
        return pdf[keys].head(1).assign(low=q[0], mid=q[1], high=q[2])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hist.select(*keys).schema) + ", low double, mid double, high double"
    return hist.groupBy(*keys).applyInPandas(run, schema)


def require_split_sizes(rows: DataFrame, keys: list[str], split: str, splits: list[str], least: int) -> None:
    """An error that names every group whose split has fewer than `least` rows.  One row for each group and split."""
    counts = {(*(r[k] for k in keys), r[split]): r["n"] for r in rows.groupBy(*keys, split).agg(F.count("*").alias("n")).collect()}
    groups = {k[:-1] for k in counts}
    small = sorted(f"{'/'.join(map(str, g))}:{s}" for g in groups for s in splits if counts.get((*g, s), 0) < least)
    if small:
        raise ValueError("too few rows in " + ", ".join(small))


def four_regimes(rows: DataFrame, target: Column, key: str, props: list[str], k: int, salt: str, features: str, distant_below: float) -> DataFrame:
    """Negatives of a target by regime: all_other_random, related_hard (most similar), distant_other (a sample of those less similar than `distant_below` to every target row) and property_matched (scaled absolute distance)."""
    own, other = rows.where(target), rows.where(~target)
    near = similarity.max_similarity(other, own, key, key, features)
    far = similarity.keep_unlike(other, own, key, key, features, distant_below).select(key)
    parts = {
        "all_other_random": hash_sample(other.select(key), key, k, f"{salt}|all"),
        "related_hard": near.orderBy(F.desc("max_similarity"), key).limit(k).select(key),
        "distant_other": hash_sample(far, key, k, f"{salt}|far"),
        "property_matched": similarity.matched_l1(other, own, key, props, k).select(key),
    }
    return reduce(DataFrame.unionAll, [p.withColumn("regime", F.lit(name)) for name, p in parts.items()])


def bootstrap_metrics(scored: DataFrame, keys: list[str], threshold: float, replicates: int, seed: int) -> DataFrame:
    """2.5, 50 and 97.5 % points of five metrics under stratified resampling: auc, average_precision, and balanced_accuracy, sensitivity and specificity at the threshold.

    Replicates redraw the classes' histograms, as in `bootstrap_auc`.
    """
    import zlib

    import numpy as np
    import pandas as pd

    names = ["auc", "average_precision", "balanced_accuracy", "sensitivity", "specificity"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        score, p, n = (pdf[c].to_numpy() for c in ("score", "p", "n"))
        group = zlib.crc32("|".join(str(pdf[k].iloc[0]) for k in keys).encode())
        got = []
        for r in range(replicates if p.sum() and n.sum() else 0):
            rng = np.random.Generator(np.random.PCG64([seed, r, group]))
            a, b = rng.multinomial(p.sum(), p / p.sum()), rng.multinomial(n.sum(), n / n.sum())
            tp, fp = a[::-1].cumsum(), b[::-1].cumsum()
            taken = np.maximum(tp + fp, 1)
            sens, spec = a[score >= threshold].sum() / p.sum(), b[score < threshold].sum() / n.sum()
            got.append(((a * (2 * (b.cumsum() - b) + b)).sum() / (2 * p.sum() * n.sum()), (a[::-1] / p.sum() * tp / taken).sum(), (sens + spec) / 2, sens, spec))
        q = np.quantile(np.array(got), [0.025, 0.5, 0.975], axis=0) if got else np.full((3, len(names)), np.nan)
        return pd.concat([pdf[keys].head(1)] * len(names), ignore_index=True).assign(metric=names, low=q[0], mid=q[1], high=q[2])

    hist = M.histogram(scored, keys)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in hist.select(*keys).schema] + ["metric string", "low double", "mid double", "high double"])
    return hist.groupBy(*keys).applyInPandas(run, schema)
