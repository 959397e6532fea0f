"""Set membership between categories, and audits of external rows against construction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_matrix(members: DataFrame, entity: str, category: str) -> DataFrame:
    """For each pair of categories a < b: shared entities, their share of each, and the Jaccard index; pairs that share nothing too.

    The number of categories is a dimension's, not the data's; the self-join is on
    the entity, after its memberships have been made distinct.
    """
    m = members.select(F.col(entity).alias("e"), F.col(category).alias("c")).distinct()
    sizes = m.groupBy("c").agg(F.count("*").alias("n"))
    # an entity's categories as one sorted array: its pairs need no second exchange
    sets = m.groupBy("e").agg(F.array_sort(F.collect_set("c")).alias("cs")).where("size(cs) > 1")
    pairs = sets.select(F.explode(F.expr("flatten(transform(cs, (x, i) -> transform(slice(cs, i + 2, size(cs)), y -> struct(x as a, y as b))))")).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("shared"))
    one, two = sizes.select(F.col("c").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("c").alias("b"), F.col("n").alias("n_b"))
    grid = one.join(two, F.col("a") < F.col("b"))
    out = grid.join(pairs, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumns({"fraction_of_a": F.col("shared") / F.col("n_a"), "fraction_of_b": F.col("shared") / F.col("n_b"), "jaccard": F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))})


def multiplicity(members: DataFrame, entity: str, category: str) -> DataFrame:
    """How many entities lie in 1, 2, .. categories."""
    per = members.groupBy(entity).agg(F.count_distinct(category).alias("categories"))
    hist = per.groupBy("categories").agg(F.count("*").alias("entities"))
    return hist.withColumn("fraction", F.col("entities") / F.sum("entities").over(W.partitionBy()))  # one row for each number of categories


def difference(rows: DataFrame, minus: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows whose key isn't in minus, the first of each key."""
    from tessera.operators.sampling import first_occurrence

    return first_occurrence(rows.join(minus.select(key).distinct(), key, "left_anti"), [key], ordinal)


def external_audit(rows: DataFrame, construction: DataFrame, ordinal: str, exact: str, parent: str) -> DataFrame:
    """Status of each external row against construction keys (exact, parent, scope: target_positive, target_negative or other).

    Scope is the first that matches in that order, or 'none'; basis is 'exact' if the
    exact key matches in any scope, else 'parent', or 'none'.  A row that matches
    nothing is a candidate unless its parent came before, whatever became of the
    earlier row; a null key is unresolved, with neither scope nor basis.
    """
    scopes = ["target_positive", "target_negative", "other"]
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    by = lambda key, name: construction.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__{name}")).agg(F.min(rank).alias(f"{name}_rank"))
    found = rows.join(by(exact, "exact"), F.col(exact) == F.col("__exact"), "left").join(by(parent, "parent"), F.col(parent) == F.col("__parent"), "left")
    best = F.least(F.col("exact_rank"), F.col("parent_rank"))
    unresolved = F.col(exact).isNull() | F.col(parent).isNull()
    scope = F.when(~unresolved, F.when(best.isNotNull(), F.element_at(F.array(*map(F.lit, scopes)), best.cast("int"))).otherwise("none"))
    basis = F.when(~unresolved, F.when(F.col("exact_rank").isNotNull(), "exact").when(F.col("parent_rank").isNotNull(), "parent").otherwise("none"))
    # null keys, however many, are spread by their ordinal
    seen = F.row_number().over(W.partitionBy(parent, F.when(F.col(parent).isNull(), F.col(ordinal))).orderBy(ordinal)) > 1
    status = F.when(unresolved, "unresolved").when(best.isNotNull(), "overlap_excluded").when(F.col("duplicate"), "duplicate_external_excluded").otherwise("true_external_candidate")
    return found.withColumn("duplicate", F.when(F.col(parent).isNull(), F.lit(False)).otherwise(seen)).withColumns({"overlap_scope": scope, "overlap_basis": basis, "status": status}).drop("__exact", "__parent", "exact_rank", "parent_rank")


def exclusion_reasons(rows: DataFrame, limit: int, ordinal: str, checks: dict[str, F.Column]) -> DataFrame:
    """The first check that holds for each row, in order, or 'retained'; rows after the limit-th retained one are left out.

    Ranks run in one order over all rows, so the caller bounds the rows (audited
    hard negatives are a reviewed list).
    """
    reason = F.lit("retained")
    for name, test in reversed(list(checks.items())):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    w = W.orderBy(ordinal).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.count_if(F.col("reason") == "retained").over(w), F.lit(0))
    return rows.withColumn("reason", reason).withColumn("__kept", before).where(F.col("__kept") < limit).drop("__kept")


def data_quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, blanks, exact duplicates and distinct values of a table, in one row."""
    blanks = F.lit(0)
    for c in columns:
        blanks = blanks + F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", 1).otherwise(0)
    whole = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    return whole.agg(F.sum("__n").alias("row_count"), F.lit(len(columns)).alias("column_count"), F.sum(blanks * F.col("__n")).alias("blank_cells"), (F.sum("__n") - F.count("*")).alias("exact_duplicates"), F.count_distinct(columns[0]).alias("distinct_first"))


def resolve(rows: DataFrame, cache: DataFrame, cas: str, name: str) -> DataFrame:
    """Look identifiers up in a cache (key, status, ..): the registry number first, else the name; nothing is fetched."""
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.trim(F.col(c)))
    key = F.coalesce(F.concat(F.lit("cas:"), filled(cas)), F.concat(F.lit("name:"), filled(name)))
    found = rows.withColumn("key", key).join(cache, "key", "left")
    return found.withColumn("status", F.when(F.col("key").isNull(), "missing_identifier").otherwise(F.coalesce("status", F.lit("not_attempted"))))
