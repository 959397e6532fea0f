"""Exact ranking metrics from score histograms.

Every metric first aggregates to one row for each group and distinct score (a
partial aggregate, so the exchange carries distinct scores and not rows); windows
then run over a group's distinct scores only.  scored tables have the columns
group keys, score (double) and positive (boolean).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: Tables with so many groups at most are broadcast.
GROUPS = 100_000


def histogram(scored: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """keys, score, p and n: positives and negatives at each distinct score."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))


def curve(hist: DataFrame, keys: list[str]) -> DataFrame:
    """At each distinct score as threshold (>=): true and false positives, and the totals.

    Sums run in two levels: inside stretches of 1/256 of the score, and over the
    stretches' totals, so no task holds all distinct scores of a group.
    """
    rows = hist.withColumn("__at", F.floor(F.col("score") * 256))
    order = W.partitionBy(*keys).orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    parts = rows.groupBy(*keys, "__at").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    above = {f"__above_{c}": F.coalesce(F.sum(f"__{c}").over(order), F.lit(0)) for c in "pn"}
    parts = parts.withColumns(above | {"pos": F.sum("__p").over(whole), "neg": F.sum("__n").over(whole)}).drop("__p", "__n").withColumnsRenamed({k: f"__k_{k}" for k in [*keys, "__at"]})
    same = F.lit(True)
    for k in [*keys, "__at"]:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    down = W.partitionBy(*keys, "__at").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)}).join(parts, same)
    return inside.withColumns({"tp": F.col("tp") + F.col("__above_p"), "fp": F.col("fp") + F.col("__above_n")}).select(*hist.columns, "tp", "fp", "pos", "neg")


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def roc_auc(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half; 0 with an empty class."""
    rows = curve(hist, keys).withColumn("below", F.col("neg") - F.col("fp"))
    pairs = F.sum(F.col("p") * (F.lit(2) * F.col("below") + F.col("n"))).cast("double")
    both = F.sum("p").cast("double") * F.sum("n")
    return rows.groupBy(*keys).agg(F.when(both > 0, pairs / (F.lit(2.0) * both)).otherwise(F.lit(0.0)).alias("auc"))


def ks_statistic(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Largest distance of the classes' distribution functions; 0 with an empty class."""
    c = curve(hist, keys)
    gap = F.abs(_rate(F.col("tp"), F.col("pos")) - _rate(F.col("fp"), F.col("neg")))
    return c.groupBy(*keys).agg(F.max(F.when((F.col("pos") > 0) & (F.col("neg") > 0), gap).otherwise(F.lit(0.0))).alias("ks"))


def average_precision(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there."""
    c = curve(hist, keys)
    step = _rate(F.col("p"), F.col("pos")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def rates(tp: Column, fp: Column, pos: Column, neg: Column) -> dict[str, Column]:
    """Sensitivity, specificity, balanced accuracy and the Matthews correlation (0 where undefined)."""
    tp, fp, pos, neg = (x.cast("double") for x in (tp, fp, pos, neg))
    fn, tn = pos - tp, neg - fp
    sens, spec = _rate(tp, pos), _rate(tn, neg)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(F.lit(0.0))
    return {"sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2, "mcc": mcc}


def at_threshold(scored: DataFrame, keys: list[str], threshold: Column, score: str = "score", positive: str = "positive") -> DataFrame:
    """Binary metrics with `score >= threshold` as the prediction."""
    hit, pos = F.col(score) >= threshold, F.col(positive)
    sums = scored.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    return sums.withColumns(rates(F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")))


def next_up(x: Column) -> Column:
    """The least double above x."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def best_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of most balanced accuracy; ties by MCC, nearness to 0.5, then the smaller.

    Tried are all distinct scores, and the next double above the largest, which takes no row.
    """
    c = curve(hist, keys)
    c = c.withColumns(rates(F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")))
    tried = lambda balanced, mcc, at: F.struct(F.round(balanced, 12).alias("a"), F.round(mcc, 12).alias("b"), (-F.abs(at - 0.5)).alias("c"), (-at).alias("d"), at.alias("threshold"), balanced.alias("balanced_accuracy"), mcc.alias("mcc"))
    best = c.groupBy(*keys).agg(F.max(tried(F.col("balanced_accuracy"), F.col("mcc"), F.col("score"))).alias("x"), F.max("score").alias("top"), F.max((F.col("neg") > 0).cast("double")).alias("other"))
    none = tried(F.col("other") / 2, F.lit(0.0), next_up(F.col("top")))
    return best.select(*keys, F.greatest("x", none).alias("x")).select(*keys, "x.threshold", "x.balanced_accuracy", "x.mcc")


def first_best_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The highest distinct score at which TPR - FPR is largest; 0.5 with an empty class."""
    c = curve(hist, keys)
    gap = F.round(_rate(F.col("tp"), F.col("pos")) - _rate(F.col("fp"), F.col("neg")), 12)
    one = (F.col("pos") == 0) | (F.col("neg") == 0)
    return c.withColumn("gap", gap).groupBy(*keys).agg(F.when(F.max(one), F.lit(0.5)).otherwise(F.max_by("score", F.struct("gap", "score"))).alias("threshold"))


def fpr_threshold(hist: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Among thresholds with FPR at most cap, the one of most TPR, the least of equals; the next double above all scores if there is none."""
    c = curve(hist, keys)
    tpr, fpr = _rate(F.col("tp"), F.col("pos")), _rate(F.col("fp"), F.col("neg"))
    ok = fpr <= cap
    best = F.max_by(F.when(ok, F.col("score")), F.when(ok, F.struct("tpr", -F.col("score"))))
    return c.withColumns({"tpr": tpr, "fpr": fpr}).groupBy(*keys).agg(F.coalesce(best, next_up(F.max("score"))).alias("threshold"), F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0)).alias("tpr"))


def decile_threshold(scored: DataFrame, keys: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Best balanced accuracy over the distinct score deciles 0.1 .. 0.9; ties to the smaller threshold."""
    deciles = scored.groupBy(*keys).agg(F.array_distinct(F.percentile(score, F.array(*(F.lit(k / 10) for k in range(1, 10))))).alias("cuts"))
    tried = scored.join(deciles, keys).select(*keys, score, positive, F.explode("cuts").alias("threshold"))
    got = at_threshold(tried, [*keys, "threshold"], F.col("threshold"), score, positive)
    return got.groupBy(*keys).agg(F.max_by("threshold", F.struct(F.round("balanced_accuracy", 12), -F.col("threshold"))).alias("threshold"), F.max("balanced_accuracy").alias("balanced_accuracy"))


def histogram_overlap(scored: DataFrame, keys: list[str], bins: int = 200, score: str = "score", positive: str = "positive", low: float = -0.05, high: float = 1.05) -> DataFrame:
    """Overlap of both classes' densities over equal bins of [low, high], the last one closed; scores outside are left out."""
    x, step = F.col(score), (high - low) / bins
    edge = lambda k: k * F.lit(step) + F.lit(low)
    near = F.least(F.floor((x - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
    at = F.when(x < edge(near), near - 1).when((x >= edge(near + 1)) & (near < bins - 1), near + 1).otherwise(near)
    binned = scored.where(x.between(low, high)).groupBy(*keys, at.alias("bin")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    whole = W.partitionBy(*keys)
    share = F.least(_rate(F.col("p"), F.sum("p").over(whole)), _rate(F.col("n"), F.sum("n").over(whole)))
    return binned.withColumn("s", share).groupBy(*keys).agg(F.sum("s").alias("overlap"))


def objective(auc: Column, ks: Column, balanced: Column, threshold: Column, overlap: Column, pos: Column, neg: Column) -> Column:
    """What grid searches minimise; 10 where a class has fewer than two rows."""
    value = F.lit(2.0) * overlap + (1 - auc) + (1 - balanced) + F.lit(0.5) * (1 - ks) + F.lit(0.2) * F.abs(threshold - F.lit(0.5))
    return F.when((pos < 2) | (neg < 2), F.lit(10.0)).otherwise(value)


def kde_overlap(scored: DataFrame, keys: list[str], points: int = 2000) -> DataFrame:
    """Overlap of both classes' Gaussian kernel densities (Scott's bandwidth) on [-0.05, 1.05], by trapezoids.

    Densities are sums over the group's distinct scores, so a group's histogram is
    what one call gets; 0 where a class has fewer than two values or no spread.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, grid = pdf["score"].to_numpy(float), np.linspace(-0.05, 1.05, points)
        density = []
        for c in ("p", "n"):
            w = pdf[c].to_numpy(float)
            total = w.sum()
            mean = (w * x).sum() / total if total else 0.0
            var = (w * (x - mean) ** 2).sum() / (total - 1) if total > 1 else 0.0
            if var <= 0:
                return pdf[keys].head(1).assign(overlap=0.0)
            h = np.sqrt(var) * total ** (-1 / 5)
            d = np.zeros(points)
            for a in range(0, len(x), 1024):
                d += (w[a : a + 1024, None] * np.exp(-0.5 * ((grid[None] - x[a : a + 1024, None]) / h) ** 2)).sum(0)
            density.append(d / np.trapezoid(d, grid))
        return pdf[keys].head(1).assign(overlap=float(np.trapezoid(np.minimum(*density), grid)))

    hist = histogram(scored, keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hist.select(*keys).schema) + ", overlap double"
    return hist.groupBy(*keys).applyInPandas(run, schema)


def summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), least, median, quartiles, largest; exact quantiles."""
    v = F.col(value).cast("double")
    q = lambda p: F.percentile(v, F.lit(p))
    return values.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max(v).alias("largest"))


def _counted(groups: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """One row for each group, kept, and what such tables are joined with: broadcast up to GROUPS of them, so rows stay where they are."""
    groups = checkpointed(groups)
    return groups, F.broadcast if groups.count() <= GROUPS else lambda df: df


def quantiles(values: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and ends: each group's exact quantiles, interpolated between the two values next to share * (n - 1); groups without values are left out.

    No task holds a group's distinct values: approximate quantiles cut each group in
    stretches, their rows are counted, and only values of the stretches with a wanted
    rank are sorted.  Any cuts give the right result; good ones leave few values.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = values.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    near = sorted({min(max(p + d, 0.0), 1.0) for p in shares for d in (-0.005, 0.005)})
    cuts = rows.groupBy(*names).agg(F.percentile_approx("__v", near, F.lit(10_000)).alias("__cuts")).withColumnsRenamed({n: f"{n}c" for n in names})
    cuts, small = _counted(cuts)

    def same(suffix: str) -> Column:
        test = F.lit(True)
        for n in names:
            test = test & F.col(n).eqNullSafe(F.col(f"{n}{suffix}"))
        return test

    stretch = sum(((F.col("__v") >= F.col("__cuts")[i]).cast("int") for i in range(len(near))), F.lit(0))
    dealt = rows.join(small(cuts), same("c")).select(*names, "__v", stretch.alias("__at"))
    counts = dealt.groupBy(*names, "__at").agg(F.count("*").alias("__n"))
    order = W.partitionBy(*names).orderBy("__at")
    whole = W.partitionBy(*names)  # as many rows as stretches
    counts = counts.withColumns({"__before": F.sum("__n").over(order) - F.col("__n"), "__all": F.sum("__n").over(whole)})
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("__all") - 1)).alias("r")) for i, p in enumerate(shares))))
    ranks = counts.withColumn("__w", place).withColumn("__rank", F.explode(F.array(F.floor("__w.r"), F.ceil("__w.r"))))
    wanted = ranks.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n"))).select(*names, "__at", "__before", F.col("__w.i").alias("__i"), F.col("__w.r").alias("__r"), "__rank").distinct()
    stretches = wanted.select(*names, "__at", "__before").distinct().withColumnsRenamed({**{n: f"{n}s" for n in names}, "__at": "__ats"})
    hist = dealt.join(small(stretches), same("s") & (F.col("__at") == F.col("__ats"))).groupBy(*names, "__at", "__before", "__v").agg(F.count("*").alias("__n"))
    upto = hist.withColumn("__upto", F.col("__before") + F.sum("__n").over(W.partitionBy(*names, "__at").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    wanted = wanted.withColumnsRenamed({**{n: f"{n}w" for n in names}, "__at": "__atw"}).drop("__before")
    hits = upto.join(wanted, same("w") & (F.col("__at") == F.col("__atw")) & (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
    share = F.col("__r") - F.floor("__r")
    low, high = F.max(F.when(F.col("__rank") == F.floor("__r"), F.col("__v"))), F.max(F.when(F.col("__rank") == F.ceil("__r"), F.col("__v")))
    ends = hits.groupBy(*names, "__i").agg((F.when(low == high, low).otherwise((1 - F.max(share)) * low + F.max(share) * high)).alias("__q"))
    found = ends.groupBy(*names).agg(*(F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"__q{i}") for i in range(len(shares))))
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), F.array(*(f"__q{i}" for i in range(len(shares)))).alias("ends"))


def trimmed(values: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean and sample deviation (at least 1e-6) of the values between two quantiles, inclusive."""
    v = F.col(value).cast("double")
    ends, small = _counted(quantiles(values, keys, value, [low, high]))
    rows = values.join(small(ends), keys).where(v.between(F.col("ends")[0], F.col("ends")[1]))
    return rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(1e-6)).alias("sd"))


def half_gaussian_fit(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, and the mean distance to it below and above (1 where a side is empty)."""
    v = F.col(value).cast("double")
    rows = values.join(values.groupBy(*keys).agg(F.avg(v).alias("mean")), keys)
    side = lambda test: F.coalesce(F.avg(F.when(test, F.abs(v - F.col("mean")))), F.lit(1.0))
    return rows.groupBy(*keys).agg(F.max("mean").alias("mean"), side(v < F.col("mean")).alias("below"), side(v > F.col("mean")).alias("above"))


def cross_matrix(scored: DataFrame, source: str, target: str, score: str, threshold: str) -> DataFrame:
    """How each source's rows respond to each target's score, and the excess of the own one over the largest foreign median."""
    q = lambda p: F.percentile(score, F.lit(p))
    cells = scored.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("n"), q(0.5).alias("median"), F.avg(score).alias("mean"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.avg((F.col(score) >= F.col(threshold)).cast("double")).alias("fraction_at_threshold"))
    foreign = F.max(F.when(F.col("source") != F.col("target"), F.col("median"))).over(W.partitionBy("target"))
    return cells.withColumn("foreign_median", foreign).withColumn("excess", F.col("median") - F.col("foreign_median"))


def tail_ratio(hist: DataFrame, keys: list[str]) -> DataFrame:
    """At each distinct score, the likelihood ratio of the classes' upper tails, each count plus a half over the total plus one."""
    c = curve(hist, keys)
    tail = lambda hits, n: (F.col(hits) + F.lit(0.5)) / (F.col(n) + F.lit(1.0))
    return c.select(*keys, "score", (tail("tp", "pos") / tail("fp", "neg")).alias("tail_ratio"))
