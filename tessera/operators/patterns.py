"""Pattern rates, assessments, gates, candidates and reuse.

Pattern hits come as a long table (entity_id, category, pattern) or as boolean
columns; categories' sizes are separate small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: So many retained units at most are broadcast; beyond, they and the rows meet by an exchange.
BROADCAST = 200_000


def unpivot_flags(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """keys, pattern and hit for each boolean column, in one pass."""
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("pattern"), F.coalesce(F.col(f), F.lit(False)).alias("hit")) for f in flags))).alias("s")).select(*keys, "s.pattern", "s.hit")


def pattern_rates(rows: DataFrame, flags: list[str], positive: str) -> DataFrame:
    """Percentage of positives and of negatives that match each pattern, and the difference."""
    long = unpivot_flags(rows, [positive], flags)
    share = lambda test: F.coalesce(F.avg(F.when(test, F.col("hit").cast("double"))), F.lit(0.0)) * 100
    return long.groupBy("pattern").agg(share(F.col(positive)).alias("positive_rate"), share(~F.col(positive)).alias("negative_rate")).withColumn("delta", F.col("positive_rate") - F.col("negative_rate"))


def assess(rows: DataFrame, flags: list[str], category: str, least_rate: float = 0.01) -> DataFrame:
    """For each pattern and target category: rates, the largest other rate, breadth (other categories of least_rate or more), smoothed enrichment and quality."""
    long = unpivot_flags(rows, [category], flags)
    per = long.groupBy("pattern", F.col(category).alias("category")).agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    whole = W.partitionBy("pattern")
    rate = F.col("hits") / F.col("n")
    top = F.row_number().over(whole.orderBy(F.desc("rate"), "category"))
    per = per.withColumn("rate", rate).withColumn("r", top)
    best = F.max(F.when(F.col("r") == 1, F.col("rate"))).over(whole)
    second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("rate"))).over(whole), F.lit(0.0))
    per = per.withColumns({"max_other": F.when(F.col("r") == 1, second).otherwise(best), "breadth": F.count_if(F.col("rate") >= least_rate).over(whole) - (F.col("rate") >= least_rate).cast("long"), "other_hits": F.sum("hits").over(whole) - F.col("hits"), "other_n": F.sum("n").over(whole) - F.col("n")})
    negative = F.when(F.col("other_n") > 0, F.col("other_hits") / F.col("other_n")).otherwise(F.lit(0.0))
    enrichment = ((F.col("hits") + F.lit(0.5)) / (F.col("n") + F.lit(1.0))) / ((F.col("other_hits") + F.lit(0.5)) / (F.col("other_n") + F.lit(1.0)))
    per = per.withColumns({"negative_rate": negative, "enrichment": enrichment}).withColumn("gap", F.col("rate") - F.col("max_other"))
    quality = F.greatest(F.col("gap"), F.lit(0.0)) * F.log2(1 + F.col("enrichment")) * F.sqrt("rate")
    return per.withColumn("quality", quality).drop("r", "other_hits", "other_n")


def reasons(gates: dict[str, Column], in_order: bool = False) -> Column:
    """The names of all gates that fail, joined by ';', sorted by name or as given; empty if none fails.  A null gate fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in gates.items())))
    return F.array_join(failed if in_order else F.array_sort(failed), ";")


def select_by_ratio(rates: DataFrame, ratio: float) -> DataFrame:
    """Patterns whose positive rate is at least `ratio` times the negative one (no negative: enough), weighted by the difference."""
    r = F.when(F.col("negative_rate") > 0, F.col("positive_rate") / F.col("negative_rate")).when(F.col("positive_rate") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return rates.withColumn("ratio", r).where((F.col("ratio") >= ratio) & (F.col("positive_rate") > 0)).withColumn("weight", F.col("delta"))


def fallback_selection(rates: DataFrame, ratio: float) -> DataFrame:
    """select_by_ratio; if that takes nothing, the three best of positive difference, else the one best; weights at least 0.1."""
    order = W.orderBy(F.desc("delta"), "pattern")
    chosen = F.coalesce(F.when(F.col("negative_rate") > 0, F.col("positive_rate") / F.col("negative_rate") >= ratio).otherwise(F.col("positive_rate") > 0), F.lit(False)) & (F.col("positive_rate") > 0)
    n = F.count_if("chosen").over(W.partitionBy())
    m = F.count_if(F.col("delta") > 0).over(W.partitionBy())
    rows = rates.withColumn("chosen", chosen).withColumns({"n": n, "m": m, "r": F.row_number().over(order)})  # one row for each pattern
    take = F.when(F.col("n") > 0, F.col("chosen")).when(F.col("m") > 0, (F.col("delta") > 0) & (F.col("r") <= 3)).otherwise(F.col("r") == 1)
    return rows.where(take).select("pattern", F.greatest("delta", F.lit(0.1)).alias("weight"))


def unit_candidates(units: DataFrame, sizes: DataFrame, least_count: int, least_share: float, most_breadth: int, least_enrichment: float) -> DataFrame:
    """Units (entity_id, category, unit) frequent in a category, narrow over categories and enriched against the best other one.

    sizes: category and total, one row each.
    """
    counts = units.dropDuplicates(["entity_id", "category", "unit"]).groupBy("unit", "category").agg(F.count("*").alias("n"))
    rows = counts.join(sizes, "category").withColumn("share", F.col("n") / F.col("total"))
    whole = W.partitionBy("unit")
    rows = rows.withColumns({"breadth": F.count("*").over(whole), "r": F.row_number().over(whole.orderBy(F.desc("share"), "category"))})
    best = F.max(F.when(F.col("r") == 1, F.col("share"))).over(whole)
    second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("share"))).over(whole), F.lit(0.0))
    other = F.when(F.col("r") == 1, second).otherwise(best)
    rows = rows.withColumn("enrichment", F.col("share") / F.greatest(other, 1.0 / F.col("total")))
    return rows.where((F.col("n") >= least_count) & (F.col("share") >= least_share) & (F.col("breadth") <= most_breadth) & (F.col("enrichment") >= least_enrichment)).select("category", "unit", "n", "share", "breadth", "enrichment")


def gate_patterns(assessed: DataFrame, keys: list[str], least_count: int = 3, least_rate: float = 0.01, least_enrichment: float = 1.25, least_gap: float = 0.01, most_breadth: int = 6, most: int = 24) -> DataFrame:
    """selected, rejection_reason (sorted, joined by ';') and weight of assessed patterns; beyond the `most` best by quality, rate and name, 'max_patterns'."""
    gates = {"positive_count": F.col("hits") >= least_count, "positive_prevalence": F.col("rate") >= least_rate, "enrichment": F.col("enrichment") >= least_enrichment, "specificity_gap": F.col("gap") >= least_gap, "category_breadth": F.col("breadth") <= most_breadth, "nonpositive_quality": F.col("quality") > 0}
    rows = assessed.withColumn("rejection_reason", reasons(gates))
    order = W.partitionBy(*keys).orderBy(F.col("rejection_reason") != "", F.desc("quality"), F.desc("rate"), "pattern")
    rows = rows.withColumn("__place", F.row_number().over(order))
    rows = rows.withColumn("rejection_reason", F.when((F.col("rejection_reason") == "") & (F.col("__place") > most), "max_patterns").otherwise(F.col("rejection_reason")))
    return rows.withColumns({"selected": F.col("rejection_reason") == "", "weight": F.when(F.col("rejection_reason") == "max_patterns", F.lit(0.0)).otherwise(F.col("quality"))}).drop("__place")


def candidate_summary(units: DataFrame, retained: DataFrame, categories: DataFrame, least_prevalence: int = 2) -> DataFrame:
    """Per method: retained units, entities that have one, exclusive and shared units, mean breadth, and the mean Jaccard index of the categories' unit sets.

    units: method, entity_id, category, unit; retained: method, unit; categories: category
    and total, one row each.  A category has a unit that `least_prevalence` of its
    entities have.  Units that are dealt by entity are not sent again before they are counted.
    """
    rows = units.select("method", "entity_id", "category", "unit")
    names = checkpointed(retained.select("method", "unit").distinct())
    if names.count() <= BROADCAST:
        kept = rows.join(F.broadcast(names), ["method", "unit"])
    else:  # the join deals rows by unit
        kept = rows.join(names, ["method", "unit"]).repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_id")
    counts = kept.dropDuplicates(["method", "entity_id", "category", "unit"]).groupBy("method", "category", "unit").agg(F.count("*").alias("n")).where(F.col("n") >= least_prevalence)
    counts = checkpointed(counts)  # read four times
    breadth = counts.groupBy("method", "unit").agg(F.count("*").alias("b"))
    per = names.join(breadth, ["method", "unit"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
    share = lambda test: F.avg(test.cast("double"))
    out = per.groupBy("method").agg(F.count("*").alias("units"), share(F.col("b") == 1).alias("exclusive"), share(F.col("b") > 1).alias("shared"), share(F.col("b") >= 3).alias("in_three"), F.avg("b").alias("mean_breadth"))
    covered = kept.select("method", "entity_id", "category").distinct().groupBy("method").agg(F.count("*").alias("coverage"))
    # pairs of categories: their number is a dimension's; shared units come from each unit's own categories
    sizes = categories.select("category").crossJoin(F.broadcast(names.select("method").distinct())).join(counts.groupBy("method", "category").agg(F.count("*").alias("n")), ["method", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one, two = sizes.select("method", F.col("category").alias("a"), F.col("n").alias("na")), sizes.select("method", F.col("category").alias("b"), F.col("n").alias("nb"))
    both = counts.select("method", "unit", F.col("category").alias("a")).join(counts.select("method", "unit", F.col("category").alias("b")), ["method", "unit"]).where("a < b").groupBy("method", "a", "b").agg(F.count("*").alias("s"))
    pairs = one.join(two, "method").where("a < b").join(both, ["method", "a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("s")
    jaccard = pairs.groupBy("method").agg(F.avg(F.when(union > 0, F.col("s") / union).otherwise(F.lit(0.0))).alias("mean_pairwise_jaccard"))
    total = categories.agg(F.sum("total").alias("entities"))
    rows = out.join(covered, "method", "left").join(jaccard, "method", "left").crossJoin(total)
    return rows.withColumns({"coverage": F.coalesce("coverage", F.lit(0)), "mean_pairwise_jaccard": F.coalesce("mean_pairwise_jaccard", F.lit(0.0))}).withColumn("coverage_fraction", F.col("coverage") / F.col("entities"))


def reuse(uses: DataFrame) -> DataFrame:
    """uses (pattern, model_id, category): who shares each pattern."""
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ";")
    return uses.groupBy("pattern").agg(F.count_distinct("model_id").alias("models"), F.count_distinct("category").alias("categories"), join("model_id").alias("model_ids"), join("category").alias("category_names")).withColumn("shared", F.col("models") > 1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a blank: the text provider's fragments."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
