"""Personalised random walks on a bipartite graph of entities and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed


#: So many frequent fragments at most are broadcast; beyond, they and the edges meet by an exchange.
BROADCAST = 200_000

#: For so many fragments at most, and where entities have no more pairs of them than the steps would read edges, the steps run over the matrix of their pairs, in one task.
FEW = 2_000


def _steps(damping: float, fragment_damping: float, linked: float, iterations: int, tolerance: float | None) -> int:
    """The step after which entities' and fragments' scores together change less than the tolerance.

    All differences of a step have one sign, and a step keeps sums but for its damping; so the change
    follows from `linked`, the part of the restart on entities with edges.
    """
    if tolerance is None:
        return iterations
    x, y, lone = damping * linked, fragment_damping * linked, damping * (1 - linked)
    for k in range(1, iterations):
        if x + y + lone < tolerance:
            return k
        x, y, lone = damping * y, fragment_damping * x, 0.0
    return iterations


def _walks(edges: DataFrame, restarts: dict[str, int], damping: float, fragment_damping: float, iterations: int, tolerance: float | None) -> DataFrame:
    """f and its score by each restart, scaled to sum 1.

    edges, read several times, holds distinct (e, f) and for each restart a boolean of e, dealt by e; restarts has
    their numbers of entities.  Only the half-steps that lead to the last fragment scores are run.
    """
    names = list(restarts)
    entities = edges.groupBy("e").agg(F.count("*").alias("de"), *(F.max(r).alias(r) for r in names))
    share = {r: F.when(F.col(r), F.lit(1.0 / max(n, 1))).otherwise(F.lit(0.0)) for r, n in restarts.items()}
    *linked, links, pairs = entities.agg(*(F.sum(share[r]) for r in names), F.sum("de"), F.sum(F.col("de").cast("double") * (F.col("de") + 1) / 2)).first()
    steps = max(_steps(damping, fragment_damping, min(v or 0.0, 1.0), iterations, tolerance) for v in linked)
    # at first the entities hold their restart, the fragments nothing
    start = 1 - damping if steps % 2 == 0 else 1.0
    rounds = len(range(1 + (steps % 2 == 0), steps, 2))
    # pairs are made once, and each round goes over the edges twice
    few = (pairs or 0) <= (links or 0) * (2 * rounds + 1) and edges.select("f").distinct().limit(FEW + 1).count() <= FEW
    if not steps:
        y = edges.select("f").distinct().select("f", *(F.lit(0.0).alias(r) for r in names))
    else:
        y = (_by_matrix if few else _by_edges)(edges, entities.select("e", "de", *(share[r].alias(r) for r in names)), names, damping, fragment_damping, start, rounds)
    y = checkpointed(y)
    total = y.agg(*(F.sum(r).alias(f"t_{r}") for r in names))
    return y.crossJoin(F.broadcast(total)).select("f", *(F.when(F.col(f"t_{r}") > 0, F.col(r) / F.col(f"t_{r}")).otherwise(F.lit(0.0)).alias(r) for r in names))  # one row


def _by_edges(edges: DataFrame, entities: DataFrame, names: list[str], damping: float, fragment_damping: float, start: float, rounds: int) -> DataFrame:
    """Half-steps over two copies of the edges, one dealt by e and one by f, so that a half-step sends sums only, and those once."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_e = checkpointed(edges.select("e", "f").sortWithinPartitions("e"))
    by_f = checkpointed(edges.select("e", "f").repartition(n, "f").sortWithinPartitions("f"))
    entities = checkpointed(entities.sortWithinPartitions("e"))

    # x holds an entity's score over its number of edges, y a fragment's over its own
    def to_f(x: DataFrame) -> DataFrame:
        return by_e.join(x, "e").groupBy("f").agg(*(F.lit(fragment_damping) * F.sum(r) for r in names), F.count("*")).toDF("f", *names, "df")

    y = to_f(entities.select("e", *((F.lit(start) * F.col(r) / F.col("de")).alias(r) for r in names)))
    for _ in range(rounds):
        # only fragments' scores are cut; longer plans fill the event log, as each of their stages logs the whole plan
        y = checkpointed(y).select("f", *((F.col(r) / F.col("df")).alias(f"g_{r}") for r in names))
        x = by_f.join(y, "f").groupBy("e").agg(*(F.sum(f"g_{r}").alias(f"g_{r}") for r in names)).join(entities, "e")
        y = to_f(x.select("e", *(((F.lit(1 - damping) * F.col(r) + F.lit(damping) * F.col(f"g_{r}")) / F.col("de")).alias(r) for r in names)))
    return y.select("f", *names)


def _by_matrix(edges: DataFrame, entities: DataFrame, names: list[str], damping: float, fragment_damping: float, start: float, rounds: int) -> DataFrame:
    """Two half-steps are one product with the matrix of the fragments' pairs, each pair's sum of 1 / de over the entities that have both; at most FEW * (FEW + 1) / 2 rows, made in one pass over the edges."""
    known = [r.f for r in edges.select("f").distinct().orderBy("f").collect()]  # FEW at most
    spark = edges.sparkSession
    codes = spark.createDataFrame([(f, k) for k, f in enumerate(known)], f"f {edges.schema['f'].dataType.simpleString()}, k int")
    held = edges.join(F.broadcast(codes), "f").groupBy("e").agg(F.array_sort(F.collect_list("k")).alias("ks"))  # FEW at most
    held = checkpointed(held.join(entities, "e").drop("e").groupBy("ks", "de").agg(*(F.sum(r).alias(r) for r in names), F.count("*").alias("times")))  # entities of the same fragments go once
    first = held.select(F.explode("ks").alias("i"), "de", *names).groupBy("i").agg(*(F.sum(F.col(r) / F.col("de")).alias(r) for r in names)).withColumns({"j": F.lit(-1), "v": F.lit(0.0)})
    each = held.select(F.posexplode("ks").alias("at", "i"), "ks", (F.col("times") / F.col("de")).alias("v"))
    pairs = each.select("i", F.explode(F.slice("ks", F.col("at") + 1, F.size("ks"))).alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))
    size, columns = len(known), list(names)

    def run(table):
        import numpy as np
        import pyarrow as pa

        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        own = j < 0
        p = np.zeros((size, len(columns)))
        p[i[own]] = np.stack([table[r].to_numpy()[own] for r in columns], 1)
        i, j, v = i[~own], j[~own], v[~own]
        m = np.zeros((size, size))
        m[i, j] = v
        m[j, i] = v
        df = m.sum(1)[:, None]  # a fragment's row of the matrix sums to its number of entities
        y = fragment_damping * start * p
        for _ in range(rounds):
            y = fragment_damping * ((1 - damping) * p + damping * (m @ (y / df)))
        return pa.table({"k": pa.array(np.arange(size, dtype=np.int32)), **{r: y[:, c] for c, r in enumerate(columns)}})

    rows = first.unionByName(pairs.select("i", "j", "v", *(F.lit(0.0).alias(r) for r in names)))
    y = rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "k int, " + ", ".join(f"{r} double" for r in names))
    return y.join(F.broadcast(codes), "k").select("f", *names)


def _dealt(edges: DataFrame) -> DataFrame:
    """The distinct edges, dealt by e and kept: nothing that groups by e or (e, f) sends them again."""
    return checkpointed(edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "e").distinct())


def bipartite_walk(edges: DataFrame, entity: str, fragment: str, restart: DataFrame | None = None, damping: float = 0.85, iterations: int = 200, tolerance: float | None = 1e-10) -> DataFrame:
    """fragment and score after personalised PageRank with restarts on entities, scores scaled to sum 1.

    Both sides are updated at once from the previous vectors; fragments begin at 0,
    entities at the restart weights (those of `restart`, else all).  With a tolerance
    the walk ends when the scores of both sides change less than that in total.
    Both sides are damped.
    """
    e = _dealt(edges.select(F.col(entity).alias("e"), F.col(fragment).alias("f")).dropna())
    if restart is None:
        e, n = e.withColumn("score", F.lit(True)), e.select("e").distinct().count()
    else:
        own = restart.select(F.col(entity).alias("e"), F.lit(True).alias("score")).distinct()
        e, n = e.join(own, "e", "left"), own.count()
    return _walks(e, {"score": n}, damping, damping, iterations, tolerance).withColumnRenamed("f", fragment)


def network_patterns(positive: DataFrame, negative: DataFrame, entity: str, fragment: str, share: float, least_enrichment: float, top: int = 24, iterations: int = 200, damping: float = 0.85, tolerance: float = 1e-10, least_prevalence_enrichment: float = 1.25) -> DataFrame:
    """Fragments frequent among positives and favoured by their walk against the negatives': weight log2(enrichment) * sqrt(prevalence), the best `top`.

    Both walks go over one graph of both sides' entities and the fragments that enough positives have; an
    entity of both sides is a node on each.  They restart on the positives and on the negatives, and are
    damped at fragments too.
    """
    side = lambda rows, own: rows.select(F.struct(F.lit(own).alias("own"), F.col(entity).alias("id")).alias("e"), F.col(fragment).alias("f"))
    every = _dealt(side(positive, True).unionByName(side(negative, False)))
    n, m = every.select("e").distinct().agg(F.count_if("e.own"), F.count_if(~F.col("e.own"))).first()
    least = max(10, -int(-share * n // 1))
    rows = every.where(F.col("e.id").isNotNull() & F.col("f").isNotNull()).withColumn("own", F.col("e.own"))
    counts = rows.groupBy("f").agg(F.count_if("own").alias("hits"), F.count_if(~F.col("own")).alias("other_hits")).where(F.col("hits") >= least)
    counts = checkpointed(counts)
    if counts.count() <= BROADCAST:
        edges = rows.join(F.broadcast(counts.select("f")), "f", "left_semi")
    else:
        edges = _dealt(rows.join(counts.select("f"), "f", "left_semi"))
    edges = edges.select("e", "f", "own", (~F.col("own")).alias("other"))
    rows = counts.join(_walks(edges, {"own": n, "other": m}, damping, damping, iterations, tolerance), "f").withColumnRenamed("f", fragment)
    rows = rows.withColumn("enrichment", (F.col("own") + F.lit(1e-15)) / (F.col("other") + F.lit(1e-15))).withColumn("prevalence", F.col("hits") / F.lit(n))
    rows = rows.withColumn("prevalence_enrichment", (F.col("hits") + 1) / F.lit(n + 2.0) / ((F.col("other_hits") + 1) / F.lit(m + 2.0)))
    rows = rows.where((F.col("enrichment") >= least_enrichment) & (F.col("prevalence_enrichment") >= least_prevalence_enrichment))
    rows = rows.withColumn("weight", F.log2("enrichment") * F.sqrt("prevalence"))
    return rows.orderBy(F.desc("weight"), F.desc("prevalence"), fragment).limit(top)


def matched_weight(edges: DataFrame, patterns: DataFrame, entity: str, fragment: str) -> DataFrame:
    """Each entity's share of the patterns' weight."""
    total = patterns.agg(F.sum("weight")).first()[0] or 1.0
    hits = edges.select(entity, fragment).distinct().join(patterns.select(fragment, "weight"), fragment)
    return hits.groupBy(entity).agg((F.sum("weight") / F.lit(total)).alias("network_score"))
