"""Decision ladders, reporting joins and summaries over result tables.

Result tables have one row for each category, regime, seed or variant; what is
gathered per group here is bounded by those, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.session import checkpointed

# -- decisions ------------------------------------------------------------------------------------------------


def hard_negative_gate(auc: Column, base_auc: Column, balanced: Column, base_balanced: Column, fpr: Column, base_fpr: Column, original_auc: Column, base_original_auc: Column) -> Column:
    """A rebuild on hard negatives is promoted if it gains 0.03 AUC and 0.01 deployed balanced accuracy on them, its deployed FPR falls by 0.03, and it loses no more than 0.03 AUC on the original set."""
    return (auc - base_auc >= 0.03) & (balanced >= base_balanced + 0.01) & (fpr <= base_fpr - 0.03) & (original_auc - base_original_auc >= -0.03)


def worst_source(responses: DataFrame, category: str, source: str, response: str, count: str) -> DataFrame:
    """category and its largest foreign response; ties to the later source by name, then the larger count."""
    worst = F.max(F.struct(F.col(response).alias("response"), F.col(source).alias("source"), F.col(count).alias("count")))
    return responses.where(F.col(category) != F.col(source)).groupBy(category).agg(worst.alias("w")).select(category, F.col("w.response").alias("worst_response"), F.col("w.source").alias("worst_source"), F.col("w.count").alias("worst_count"))


def publication_decision(own: DataFrame, worst: DataFrame, category: str, response: str, hard_auc: str) -> DataFrame:
    """'retain' if the own response exceeds the worst foreign one and the hard-background AUC is over 0.5, else 'exclude'."""
    rows = own.join(worst, category)
    keep = (F.col(response) > F.col("worst_response")) & (F.col(hard_auc) > 0.5)
    return rows.withColumns({"own_minus_worst": F.col(response) - F.col("worst_response"), "publication_decision": F.when(keep, "retain").otherwise("exclude")})


def recommended_mode(summary: DataFrame, panels: Iterable[str], audited: str = "audited_hard_negative", matched: str = "property_matched") -> DataFrame:
    """Per category: worst and best regime by mean AUC, the property-matched and preferred rows, and the recommended mode.

    summary: category, regime, auc_mean, balanced_accuracy_mean, and ordinal, the input
    order, which breaks ties: the earliest of the worst, the latest of the best.
    """
    row = F.struct("regime", "auc_mean", "balanced_accuracy_mean")
    first = lambda name: F.min_by(F.when(F.col("regime") == name, row), F.when(F.col("regime") == name, F.col("ordinal")))
    got = summary.groupBy("category").agg(F.min_by(row, F.struct("auc_mean", "ordinal")).alias("worst"), F.max_by(row, F.struct("auc_mean", "ordinal")).alias("best"), first(matched).alias("m"), first(audited).alias("a"))
    got = got.withColumn("m", F.coalesce("m", "worst")).withColumn("p", F.coalesce("a", "m"))
    auc, balanced = F.col("worst.auc_mean"), F.col("worst.balanced_accuracy_mean")
    mode = F.when(F.col("category").isin(list(panels)), "evidence_panel").when((auc >= 0.8) & (balanced >= 0.75), "robust_score").when(auc >= 0.7, "conditional_score").otherwise("experimental_score")
    columns = [F.col("worst.regime").alias("worst_regime"), auc.alias("worst_auc_mean"), balanced.alias("worst_balanced_accuracy_mean"), F.col("best.regime").alias("best_regime"), F.col("best.auc_mean").alias("best_auc_mean")]
    named = [F.col(f"{c}.{x}").alias(f"{name}_{x}") for c, name in (("m", "matched"), ("p", "preferred")) for x in ("regime", "auc_mean", "balanced_accuracy_mean")]
    return got.select("category", mode.alias("recommended_mode"), *columns, *named)


def reporting_policy(category: Column, auc: Column, balanced: Column, from_robustness: Column, positive_delta: Column, not_prioritised: list[str], supported: list[str]) -> Column:
    """The policy under which a category is reported; the first that holds, in this order."""
    ba = F.coalesce(balanced, F.lit(0.0))
    return (
        F.when(category.isin(not_prioritised), "not_prioritized_broad_category").when(category.isin(supported), "preserved_weak_broad_category_with_supporting_panels")
        .when(from_robustness & (auc >= 0.9) & (ba >= 0.85), "robust_built_in_score").when((auc >= 0.75) & (ba >= 0.7), "bounded_candidate_do_not_promote_without_multi_seed_confirmation")
        .when(positive_delta, "experimental_broad_category_attempt_positive_delta").otherwise("preserved_weak_broad_category")
    )


def by_value_sets(rows: DataFrame, key: str, value: str, any_of: list[str], exactly: list[list[str]]) -> DataFrame:
    """Keys that have one of the values any_of, or whose set of values equals one of `exactly`."""
    held = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("s"))  # as many as there are different values
    test = F.lit(False)
    for v in any_of:
        test = test | F.array_contains("s", v)
    for s in exactly:
        test = test | (F.col("s") == F.array(*map(F.lit, sorted(s))))
    return held.where(test).select(key)


def supporting_panels(panels: DataFrame, parents: DataFrame, parent: str, regime: str = "property_matched", least_auc: float = 0.8, least_balanced: float = 0.78) -> DataFrame:
    """Panel rows of one regime that are good enough, with their parent's columns (inner join); a missing figure counts as 0."""
    good = (F.col("regime") == regime) & (F.coalesce("auc_mean", F.lit(0.0)) >= least_auc) & (F.coalesce("balanced_accuracy_mean", F.lit(0.0)) >= least_balanced)
    return panels.where(good).join(parents, parent)


# -- joins ----------------------------------------------------------------------------------------------------


def enrich(rows: DataFrame, extra: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the text columns of `extra`, blank where there are none.  extra: one row for each key."""
    found = rows.join(extra.select(*keys, *columns), keys, "left")
    return found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def last_of_each(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key in input order: a lookup whose later entries replace earlier ones."""
    order = W.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def first_match(rows: DataFrame, keys: list[str], ordinal: str, **equal: object) -> DataFrame:
    """The first row in input order of each key, among those that match the given values."""
    for c, v in equal.items():
        rows = rows.where(F.col(c) == F.lit(v))
    order = W.partitionBy(*keys).orderBy(ordinal)
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def shared_counts(members: DataFrame, parent: DataFrame, group: str, key: str) -> DataFrame:
    """group, its distinct members, and how many of them the parent has."""
    own = members.select(group, key).distinct()
    marks = parent.select(key, F.lit(1).alias("__in")).distinct()
    return own.join(marks, key, "left").groupBy(group).agg(F.count("*").alias("members"), F.count("__in").alias("shared"))


# -- sets -----------------------------------------------------------------------------------------------------


def union_sets(members: DataFrame, key: str, category: str, names: list[str]) -> DataFrame:
    """Distinct keys of several categories."""
    return members.where(F.col(category).isin(names)).select(key).distinct()


def intersect_sets(members: DataFrame, key: str, category: str, names: list[str]) -> DataFrame:
    """Keys that all of the categories have."""
    found = members.where(F.col(category).isin(names)).groupBy(key).agg(F.count_distinct(category).alias("n"))
    return found.where(F.col("n") == len(set(names))).select(key)


# -- summaries ------------------------------------------------------------------------------------------------


def external_summary(rows: DataFrame, category: str, status: str, score: str, threshold: str) -> DataFrame:
    """Per category: rows by status, and the recovery of true external candidates: count, share at the threshold, median, least and most.

    A null score is an invalid one and takes no part in the recovery.
    """
    is_ = lambda name: F.col(status) == name
    scored = is_("true_external_candidate") & F.col(score).isNotNull()
    value = F.when(scored, F.col(score))
    n, hits = F.count(value), F.count_if(scored & (F.col(score) >= F.col(threshold)))
    return rows.groupBy(category).agg(
        F.count("*").alias("raw_candidates"), F.count_if(~is_("unresolved")).alias("resolved"), *(F.count_if(is_(s)).alias(s) for s in ("overlap_excluded", "duplicate_external_excluded", "unresolved", "true_external_candidate")),
        n.alias("scored"), F.count_if(is_("true_external_candidate") & F.col(score).isNull()).alias("invalid_at_scoring"), hits.alias("recovered"), F.when(n > 0, hits / n).alias("recovery_fraction"), F.percentile(value, F.lit(0.5)).alias("median_score"), F.min(value).alias("least_score"), F.max(value).alias("most_score"),
    )


def parent_coverage(rows: DataFrame, category: str, parent: str, scope: str, known: DataFrame) -> DataFrame:
    """Per category: records, resolved ones, distinct external parents, and how many of them the target's positives have, against `known` (category, parents)."""
    has = F.col(parent).isNotNull()
    shared = has & (F.col(scope) == "target_positive")
    got = rows.groupBy(category).agg(F.count("*").alias("records"), F.count_if(has).alias("resolved"), F.count_distinct(parent).alias("external_parents"), F.count_distinct(F.when(shared, F.col(parent))).alias("shared_parents"))
    got = got.join(known, category)
    return got.withColumns({"known_only": F.col("parents") - F.col("shared_parents"), "external_only": F.col("external_parents") - F.col("shared_parents"), "coverage": F.when(F.col("external_parents") > 0, F.col("shared_parents") / F.col("external_parents"))})


def method_dominance(outcomes: DataFrame, keys: list[str], method: str) -> DataFrame:
    """The method chosen most often (ties: the first by name), and its share of all outcomes."""
    counts = outcomes.groupBy(*keys, method).agg(F.count("*").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), method)
    rows = counts.withColumns({"r": F.row_number().over(order), "total": F.sum("n").over(W.partitionBy(*keys))})
    return rows.where("r = 1").select(*keys, F.col(method).alias("dominant_method"), (F.col("n") / F.col("total")).alias("method_consistency"))


def pattern_stability(sets: DataFrame, keys: list[str], seed: str, items: str) -> DataFrame:
    """Mean Jaccard index of the seeds' pattern sets in pairs; 1 with fewer than two seeds, and for two empty sets."""
    one, two = sets.select(*keys, F.col(seed).alias("a"), F.col(items).alias("sa")), sets.select(*keys, F.col(seed).alias("b"), F.col(items).alias("sb"))
    union = F.size(F.array_union("sa", "sb"))
    pairs = one.join(two, keys).where("a < b").withColumn("j", F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("sa", "sb")) / union))
    return sets.select(*keys).distinct().join(pairs.groupBy(*keys).agg(F.avg("j").alias("j")), keys, "left").select(*keys, F.coalesce("j", F.lit(1.0)).alias("pattern_stability"))


def best_and_baseline(rows: DataFrame, keys: list[str], variant: str, ordinal: str) -> DataFrame:
    """The variant of most mean AUC, then balanced accuracy (the first of equals), and the first one whose name begins with 'baseline'."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.col(variant).startswith("baseline")
    return rows.groupBy(*keys).agg(F.max_by(variant, F.struct(zero("auc_mean").alias("a"), zero("balanced_accuracy_mean").alias("b"), (-F.col(ordinal)).alias("o"))).alias("best"), F.min_by(F.when(base, F.col(variant)), F.when(base, F.col(ordinal))).alias("baseline"))


def regime_matrix(rows: DataFrame, category: str, regime: str, regimes: list[str], measures: list[str]) -> DataFrame:
    """One row for each category and listed regime: the measures' means, the number of runs, and 'missing' where there is none."""
    got = rows.groupBy(category, regime).agg(*(F.avg(m).alias(m) for m in measures), F.count("*").alias("runs"))
    grid = rows.select(category).distinct().select(category, F.explode(F.array(*map(F.lit, regimes))).alias(regime))
    return grid.join(got, [category, regime], "left").withColumns({"runs": F.coalesce("runs", F.lit(0)), "status": F.when(F.col("runs").isNull(), "missing").otherwise("measured")})


def reporting_table(parts: dict[str, DataFrame], order: list[str], rank: Column) -> DataFrame:
    """Rows of all levels in one table with a level column and a place by level, then the given columns; missing columns are null."""
    out = None
    for k, (level, rows) in enumerate(parts.items()):
        rows = rows.withColumns({"level": F.lit(level), "__k": F.lit(k)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy("level").orderBy(rank, *order))
    return out.withColumn("place", place).drop("__k")


def candidate_pool(units: DataFrame, keys: list[str], unit: str, count: str, most: int = 96) -> DataFrame:
    """The `most` frequent units of each group, ties by name."""
    order = W.partitionBy(*keys).orderBy(F.desc(count), unit)
    return units.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def evidence_families(members: DataFrame, cluster: str, key: str, flags: list[str], props: list[str], top: int = 6, motifs: int = 4, least: float = 0.2) -> DataFrame:
    """The `top` largest clusters: members, the `motifs` most frequent flags that a fifth of the members have, and the properties' medians.

    Clusters of one size go by their label, flags of one count as listed.
    """
    sums = [F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}") for f in flags]
    rows = members.groupBy(cluster).agg(F.count("*").alias("members"), *sums, *(F.percentile(F.col(p).cast("double"), F.lit(0.5)).alias(f"median_{p}") for p in props))
    rows = rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("members"), cluster))).where(F.col("place") <= top)  # one row for each cluster
    named = F.array_sort(F.array(*(F.struct((-F.col(f"n_{f}")).alias("n"), F.lit(k).alias("k"), F.lit(f).alias("name")) for k, f in enumerate(flags))))
    good = F.filter(F.slice(F.filter(named, lambda x: x["n"] < 0), 1, motifs), lambda x: -x["n"] / F.col("members") >= least)
    return rows.select(cluster, "place", "members", F.array_join(F.transform(good, lambda x: x["name"]), "; ").alias("top_motifs"), *(f"median_{p}" for p in props))


def medoids(members: DataFrame, cluster: str, key: str, features: str) -> DataFrame:
    """Each cluster's member of most mean similarity to all members (itself at 1), ties to the smaller key; members without features are like themselves only.

    Members of a cluster with the same set have the same sum, so each set is compared once, with its members as weight.
    """
    rows = members.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.col(key).alias("a"), F.col(features).alias("f"))
    one = checkpointed(blocks.sets(rows, "f", "c", "a").groupBy("c", "f").agg(F.min("a").alias("a"), F.count("*").alias("x")))
    sums = blocks.compared(one.select("c", "a", "f"), one.select("c", "f", "x"), "sums", by="c").groupBy("a").agg(F.sum("s").alias("s"))
    bare = rows.where(F.coalesce(F.size(F.array_compact("f")), F.lit(0)) <= 0).select("c", "a", F.lit(1.0).alias("s"))
    rest = one.select("c", "a").join(sums, "a").select("c", "a", "s").unionByName(bare)
    best = rest.groupBy("c").agg(F.min_by(F.struct(F.col("a").alias("k"), "s"), F.struct((-F.round("s", 9)).alias("x"), F.col("a").alias("y"))).alias("m"))
    return best.join(rows.groupBy("c").agg(F.count("*").alias("members")), "c").select(F.col("c").alias(cluster), "members", F.col("m.k").alias("medoid"), (F.col("m.s") / F.col("members")).alias("mean_similarity"))


def taxonomy(prototypes: DataFrame, official: DataFrame, category: str, name: str) -> DataFrame:
    """Named subtypes of both kinds in one table with where they come from and their place in their category; a name of both kinds is official."""
    both = prototypes.select(category, name, F.lit("prototype").alias("origin")).unionByName(official.select(category, name, F.lit("official").alias("origin")))
    one = both.groupBy(category, name).agg(F.min("origin").alias("origin"))  # 'official' comes before 'prototype'
    return one.withColumn("place", F.row_number().over(W.partitionBy(category).orderBy("origin", name)))


def family_metadata(panels: DataFrame, sources: DataFrame, key: str, value: str) -> DataFrame:
    """Panels with the distinct sources of their key, sorted and joined; blank where there are none."""
    held = sources.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), "; ").alias("sources"))  # a family's sources are a few names
    return panels.join(held, key, "left").withColumn("sources", F.coalesce("sources", F.lit("")))


def metric_pivot(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each listed name with the mean of its values."""
    return rows.groupBy(*keys).pivot(name, names).agg(F.avg(value))


def compared(rows: DataFrame, one: str, other: str) -> DataFrame:
    """The difference of two columns, and whether the first is the larger, as yes or no; blank where one is missing."""
    delta = F.col(one) - F.col(other)
    return rows.withColumns({"delta": delta, "improved": F.when(delta.isNull(), "").when(delta > 0, "yes").otherwise("no")})
