"""Golden values, ties, empty sets and guards of the library's operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import graph, membership, metrics, patterns, sampling, scoring, similarity
from tessera.sources import tables


def one(df, column):
    return df.first()[column]


def test_range_motif_golden(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, True, False)], "id long, a double, b double, p boolean, q boolean")
    m = scoring.RangeMotif("m", "c", 0.5, ranges={"a": (1, 2), "b": (3, 4)}, patterns={"p": 3.0, "q": 1.0}, weight=0.4)
    r = scoring.score_all(rows, [m, m], "id").collect()
    assert len(r) == 1  # a repeated model counts once
    assert r[0].score == pytest.approx(0.4 * 0.5 + 0.6 * 0.75) and r[0].matched_patterns == ["p"]
    assert r[0].decision == "likely c"


def test_empty_model_and_invalid_row(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None)], "id long, a double")
    r = {x.entity_id: x for x in scoring.score_all(rows, [scoring.RangeMotif("m", "c", 0.5)], "id", F.col("a").isNotNull()).collect()}
    assert r[1].score == 0.0 and r[2].score == scoring.INVALID_SCORE and r[2].decision == "invalid input"


def test_specificity_order_with_calibration_below_threshold(spark):
    rows = spark.createDataFrame([("m", True, 0.52, 0.55), ("m", True, 0.6, 0.55), ("n", True, 1.0, 0.1)], "model_id string, valid boolean, score double, threshold double")
    got = [x.specificity for x in scoring.specificity(rows, {"m": 0.5}).collect()]
    assert got == ["below", "high_specificity", "unavailable"]


def test_ranks_keep_release_order_on_ties(spark):
    rows = spark.createDataFrame([(1, True, 0.5, 0.1, 1), (1, True, 0.5, 0.1, 0)], "entity_id long, valid boolean, score double, margin double, release_order int")
    assert {x.release_order: x.score_rank for x in scoring.ranked(rows).collect()} == {0: 1, 1: 2}


def _hist(spark, rows):
    return metrics.histogram(spark.createDataFrame(rows, "g string, score double, positive boolean"), ["g"])


def test_auc_ties_and_one_class(spark):
    h = _hist(spark, [("tied", 0.5, True), ("tied", 0.5, False), ("one", 0.3, True), ("two", 0.9, True), ("two", 0.1, False)])
    assert {r.g: r.auc for r in metrics.roc_auc(h, ["g"]).collect()} == {"tied": 0.5, "one": 0.0, "two": 1.0}
    assert {r.g: r.ks for r in metrics.ks_statistic(h, ["g"]).collect()} == {"tied": 0.0, "one": 0.0, "two": 1.0}
    assert {r.g: r.threshold for r in metrics.first_best_threshold(h, ["g"]).collect()}["one"] == 0.5


def test_curves_over_many_stretches_and_null_groups(spark):
    import random

    r = random.Random(8)
    rows = [(g, r.uniform(-3, 900), r.random() < 0.4) for g in ("a", None) for _ in range(150)]
    h = _hist(spark, rows)
    got = {x.g: x.auc for x in metrics.roc_auc(h, ["g"]).collect()}
    for g in ("a", None):
        p, n = ([s for k, s, y in rows if k == g and y == want] for want in (True, False))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)))
    c = metrics.curve(h.drop("g"), []).collect()
    assert all((x.tp, x.fp) == (sum(s >= x.score and y for _, s, y in rows), sum(s >= x.score and not y for _, s, y in rows)) for x in c) and len(c) == 300


def test_no_threshold_under_cap(spark):
    h = _hist(spark, [("a", 0.5, True), ("a", 0.5, False)])

    got = metrics.fpr_threshold(h, ["g"], 0.1).first()
    assert (got.threshold, got.tpr) == (math.nextafter(0.5, math.inf), 0.0)
    best = metrics.best_threshold(_hist(spark, [("a", 0.9, False), ("a", 0.2, True)]), ["g"]).first()
    assert (best.threshold, best.balanced_accuracy) == (0.2, 0.5)  # the double above 0.9 takes no row, and is further from 0.5
    assert metrics.best_threshold(_hist(spark, [("a", 0.4, False)]), ["g"]).first().threshold == math.nextafter(0.4, math.inf)


def test_jaccard_of_empty_sets(spark):
    df = spark.range(1).select(S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"), 1.0).alias("a"), S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"), 0.0).alias("b"))
    assert tuple(df.first()) == (1.0, 0.0)


def test_hash_sample_is_stable_under_order_and_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k for r in sampling.hash_sample(rows, "k", 40, "s").collect()}
    b = {r.k for r in sampling.hash_sample(rows.orderBy(F.rand(3)).repartition(7), "k", 40, "s").collect()}
    assert a == b and len(a) == 40


def test_audit_statuses(spark):
    sets = spark.createDataFrame([("x1", "p1", "target_positive"), ("x2", "p2", "target_negative"), ("x7", "p3", "other")], "x string, par string, scope string")
    rows = spark.createDataFrame([(1, "x1", "p1"), (2, "y", "p1"), (3, "z", "p9"), (4, "z2", "p9"), (5, None, None), (6, "x2", "p2"), (7, "x7", "p1")], "i long, x string, par string")
    got = {r.i: (r.status, r.overlap_basis) for r in membership.external_audit(rows, sets, "i", "x", "par").collect()}
    assert got == {1: ("overlap_excluded", "exact"), 2: ("overlap_excluded", "parent"), 3: ("true_external_candidate", "none"), 4: ("duplicate_external_excluded", "none"), 5: ("unresolved", None), 6: ("overlap_excluded", "exact"), 7: ("overlap_excluded", "exact")}  # 7: an exact match in any scope comes first


def test_keep_unlike_without_reference(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, [])], "id long, f array<string>")
    assert similarity.keep_unlike(rows, rows.limit(0), "id", "id", "f", 0.3).count() == 2
    assert {r.id: r.max_similarity for r in similarity.max_similarity(rows, rows.where("id = 1"), "id", "id", "f").collect()} == {1: 1.0, 2: 0.0}


def test_prefix_filter_loses_no_pair(spark):
    import random

    r = random.Random(1)
    sets = {i: sorted(r.sample(range(14), r.randint(1, 8))) for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id long, f array<int>")
    got = {(x.a, x.b) for x in similarity.pair_similarities(rows, rows, "id", "id", "f", 0.5).collect()}
    want = {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.5}
    assert got == want


def test_walk_against_power_iteration(spark):
    import numpy as np

    edges = [("a", 1), ("a", 2), ("b", 2), ("c", 3)]
    got = {r.f: r.score for r in graph.bipartite_walk(spark.createDataFrame(edges, "e string, f long"), "e", "f", iterations=7, tolerance=None).collect()}
    m = np.zeros((3, 3))
    for e, f in edges:
        m["abc".index(e), f - 1] = 1
    x, y, p = np.full(3, 1 / 3), np.zeros(3), np.full(3, 1 / 3)
    for _ in range(7):
        x, y = 0.15 * p + 0.85 * (m / m.sum(0)) @ y, 0.85 * (m / m.sum(1)[:, None]).T @ x
    assert [got[k] for k in (1, 2, 3)] == pytest.approx(list(y / y.sum()))


def test_network_patterns_against_dense_walks(spark):
    import random

    import numpy as np

    r = random.Random(5)
    # entity 0 is on both sides, entity 99 has no frequent fragment; fragment 11 is rare among positives
    sides = [{i: {f for f in range(11) if r.random() < (0.7 if (f < 5) == own else 0.35)} | ({11} if not own else set()) for i in [0, *range(1 + 50 * (not own), 41 + 50 * (not own))]} for own in (True, False)]
    sides[0][99] = {11}
    frames = [spark.createDataFrame([(i, f) for i, fs in s.items() for f in fs], "e long, f long") for s in sides]
    got = {x.f: x for x in graph.network_patterns(*frames, "e", "f", 0.01, 1.05).collect()}
    n, m = map(len, sides)
    rows = [fs for s in sides for fs in s.values()]
    vocabulary = [f for f in range(12) if sum(f in fs for fs in sides[0].values()) >= 10]
    g = np.array([[float(f in fs) for f in vocabulary] for fs in rows])
    de, df = np.maximum(g.sum(1), 1), np.maximum(g.sum(0), 1)

    def walk(at):
        p = np.zeros(len(rows))
        p[at] = 1 / len(p[at])
        x, y = p, np.zeros(len(vocabulary))
        for _ in range(200):
            nx, ny = 0.15 * p + 0.85 * g @ (y / df), 0.85 * g.T @ (x / de)
            moved = abs(nx - x).sum() + abs(ny - y).sum()
            x, y = nx, ny
            if moved < 1e-10:
                break
        return y / y.sum()

    own, other = walk(slice(0, n)), walk(slice(n, None))
    want = {}
    for k, f in enumerate(vocabulary):
        a, b = g[:n, k].sum(), g[n:, k].sum()
        if own[k] / other[k] >= 1.05 and (a + 1) / (n + 2) / ((b + 1) / (m + 2)) >= 1.25:
            want[f] = (own[k], other[k], math.log2(own[k] / other[k]) * math.sqrt(a / n))
    assert 0 < len(want) < len(vocabulary) < 12 and got.keys() == want.keys()
    for f, w in want.items():
        assert (got[f].own, got[f].other, got[f].weight) == pytest.approx(w, rel=1e-8)


def test_gate_reasons_and_order(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id long, x double")
    gates = {"z": F.col("x") > 1, "a": F.col("x") > 5}
    assert [r.f for r in df.select(patterns.reasons(gates).alias("f")).collect()] == ["a", "a;z"]
    assert [r.f for r in df.select(patterns.reasons(gates, True).alias("f")).collect()] == ["a", "z;a"]


def test_fixed6_rounds_the_binary_value(spark):
    assert one(spark.range(1).select(tables.fixed6(F.lit(0.1234565)).alias("s")), "s") == "0.123456"


def test_column_resolution_and_guard(tmp_path):
    assert tables.resolve_column(["x", "smiles"]) == "smiles"
    assert tables.resolve_column(["SMILEs"], mode="nocase") == "SMILEs"
    with pytest.raises(ValueError):
        tables.resolve_column(["x"])
    tables.guard_output(str(tmp_path / "o"), "s1", [])
    tables.guard_output(str(tmp_path / "o"), "s1", [])
    with pytest.raises(ValueError):
        tables.guard_output(str(tmp_path / "o"), "s2", [])


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.scoring import score_stream

    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, a double")
    rows.write.parquet(str(tmp_path / "in"))
    m = scoring.RangeMotif("m", "c", 0.5, ranges={"a": (3, 9)}, weight=1.0)
    q = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), [m], "id", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r.entity_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.entity_id: r.score for r in scoring.score_all(rows, [m], "id").collect()}
    assert math.isclose(sum(got.values()), 7.0)


def test_kde_overlap_against_sums_of_kernels(spark):
    import numpy as np

    r = np.random.default_rng(2)
    p, n = r.normal(0.6, 0.1, 40).round(2), r.normal(0.4, 0.15, 60).round(2)
    rows = [("a", float(x), True) for x in p] + [("a", float(x), False) for x in n]
    got = metrics.kde_overlap(spark.createDataFrame(rows, "g string, score double, positive boolean"), ["g"]).first().overlap
    grid = np.linspace(-0.05, 1.05, 2000)
    density = []
    for x in (p, n):
        h = x.std(ddof=1) * len(x) ** -0.2
        d = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1)
        density.append(d / np.trapezoid(d, grid))
    assert got == pytest.approx(np.trapezoid(np.minimum(*density), grid), abs=1e-9)


def test_bootstraps_surround_the_estimate(spark):
    from tessera.operators import construction, validation

    rows = [("a", i / 50, i % 50 > 20 + (i * 7) % 19) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, score double, positive boolean")
    h = metrics.histogram(df, ["g"])
    auc = one(metrics.roc_auc(h, ["g"]), "auc")
    got = validation.bootstrap_auc(h, ["g"], 200, 1).first()
    assert got.low < auc < got.high and abs(got.mid - auc) < 0.02
    pairs = df.withColumn("base", F.lit(0.5))
    d = construction.paired_bootstrap(pairs, ["g"], "score", "base", "positive", 0.9, 0.5, 200, 1).first()
    assert d.delta_auc_lower < auc - 0.5 < d.delta_auc_upper
    assert construction.paired_bootstrap(pairs, ["g"], "score", "base", "positive", 0.9, 0.5, 0, 1).first().delta_auc_median != 0  # NaN
    same = construction.paired_bootstrap(pairs, ["g"], "score", "score", "positive", 0.9, 0.9, 50, 1).first()
    assert (same.delta_auc_lower, same.delta_balanced_accuracy_upper) == (0.0, 0.0)


def test_neighbour_clusters_by_hand(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "k long")
    got = {r.item: r.centre for r in similarity.neighbour_clusters(pairs, items, "k").collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}


def test_neighbour_clusters_against_the_sequence(spark):
    import random

    r = random.Random(4)
    links = {(r.randrange(80), r.randrange(80)) for _ in range(130)}
    near = {i: {b for a, b in links | {(b, a) for a, b in links} if a == i and b != i} for i in range(80)}
    free, want = set(near), {}
    for a in sorted(near, key=lambda i: (-len(near[i]), i)):
        if a in free:
            own = {a} | near[a] & free
            want |= dict.fromkeys(own, a)
            free -= own
    got = similarity.neighbour_clusters(spark.createDataFrame(sorted(links), "a long, b long"), spark.createDataFrame([(i,) for i in range(80)], "k long"), "k")
    assert {x.item: x.centre for x in got.collect()} == want and got.count() == 80


def test_promotion_failures_in_order(spark):
    from tessera.operators import construction

    good = {"seed_count": 3, "all_won_validation": True, "all_structural": True, "worst_auc": 0.9, "worst_balanced_accuracy": 0.8, "delta_auc_fixed": 0.02, "delta_balanced_accuracy_fixed": 0.02, "delta_auc_property": 0.02, "delta_balanced_accuracy_property": 0.02, "least_auc_ci": 0.01, "least_balanced_accuracy_ci": 0.01, "mean_specificity_gap": 0.2, "worst_off_target": 0.1, "method_consistency": 1.0, "pattern_stability": 0.5}
    bad = good | {"seed_count": 2, "least_auc_ci": float("nan"), "worst_off_target": 0.7, "pattern_stability": 0.1}
    got = [r.failure_reasons for r in construction.promotion_failures(spark.createDataFrame([good, bad])).orderBy("seed_count").collect()]
    assert got == ["insufficient_scaffold_seeds;paired_auc_ci_not_positive;cross_category_off_target_rate;selected_pattern_instability", ""]


def _random_sets(seed, n, names):
    import random

    r = random.Random(seed)
    # one name in nearly all sets, some frequent, many rare; every fifth set is a copy, some are empty
    made = [sorted({"all"} | {f"often{r.randrange(12)}" for _ in range(r.randrange(8))} | {f"rare{r.randrange(names)}" for _ in range(r.randrange(6))} - ({"all"} if r.random() < 0.1 else set())) for _ in range(n)]
    return {k: made[k - 1] if k % 5 == 4 else ([] if k % 37 == 0 else made[k]) for k in range(n)}


def _jaccard(a, b):
    return len(set(a) & set(b)) / max(len(set(a) | set(b)), 1)


def test_similarities_by_blocks_make_no_pairs(spark, monkeypatch):
    from tessera.operators import blocks

    monkeypatch.setattr(blocks, "LEAST", 500)  # several cells
    one, two = _random_sets(1, 150, 300), _random_sets(2, 120, 300)
    rows = spark.createDataFrame(list(one.items()), "id long, f array<string>")
    reference = spark.createDataFrame([(k, f, "xyz"[k % 3]) for k, f in two.items()], "id long, f array<string>, c string")
    most = {k: max(_jaccard(f, g) for g in two.values()) for k, f in one.items()}
    made = similarity.max_similarity(rows, reference, "id", "id", "f")
    assert {r.id: r.max_similarity for r in made.collect()} == most
    assert "explode(f" not in made._jdf.queryExecution().analyzed().toString()  # no inverted index, whose pairs grow with the square of a feature's rows
    assert {r.id for r in similarity.keep_unlike(rows, reference, "id", "id", "f", 0.5).collect()} == {k for k, s in most.items() if s < 0.5}
    got = {r.id: (r.nearest, r.similarity) for r in similarity.nearest_category(rows, reference, "id", "id", "f", "c", ["y", "x", "z"]).collect()}
    first = {k: [c for c in "yxz" if any(_jaccard(f, g) == most[k] for i, g in two.items() if "xyz"[i % 3] == c)][0] if most[k] else None for k, f in one.items()}
    assert got == {k: (first[k], most[k]) for k in one}


def test_set_clusters_and_medoids_of_whole_tables(spark, monkeypatch):
    from tessera.operators import blocks, reporting

    monkeypatch.setattr(blocks, "LEAST", 500)
    sets = _random_sets(3, 160, 40)
    rows = spark.createDataFrame([(k, f, k % 3) for k, f in sets.items()], "id long, f array<string>, c long")
    near = {k: [j for j, g in sets.items() if j != k and _jaccard(f, g) >= 0.5] for k, f in sets.items()}
    want = {}
    for k in sorted(near, key=lambda k: (-len(near[k]), k)):
        if k not in want:
            want[k] = k
            want |= {j: k for j in near[k] if j not in want}
    for most in (similarity.ONE_TASK, 10):  # by one task, and in rounds
        monkeypatch.setattr(similarity, "ONE_TASK", most)
        assert {r["item"]: r.centre for r in similarity.set_clusters(rows, "id", "f", 0.5).collect()} == want
    got = {r.c: (r.members, r.medoid, round(r.mean_similarity, 9)) for r in reporting.medoids(rows, "c", "id", "f").collect()}
    for c in range(3):
        own = [k for k in sets if k % 3 == c]
        total = {k: sum(1 if j == k else _jaccard(sets[j], sets[k]) for j in own) for k in own}
        best = min(own, key=lambda k: (-round(total[k], 9), k))
        assert got[c] == (len(own), best, round(total[best] / len(own), 9))


def test_cluster_medoids_reads_its_whole_table(spark):
    from tessera.plans import catalog_reports

    data = "/root/testdata/sf0.001"
    assert sum(r.members for r in catalog_reports.cluster_medoids(spark, data).collect()) == spark.read.parquet(f"{data}/embeddings.parquet").count()


def test_canonical_counts_same_as_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from tessera.plans import catalog, catalog_reports

    rows = [(1, "en", ""), (2, "en", None), (3, "en", "a"), (9, "en", "b"), (None, "en", "c"), (10, None, "  "), (18, None, ""), (11, "de", ""), (12, "de", "\u0130stanbul \U0001f600 e\u0301" + "x" * 30), (13, "de", "x\x00y"), (14, "de", "x")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog_reports.canonical_counts(spark, str(tmp_path)).select("category", "n", "invalid", "distinct_values").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(c.execute(catalog.SQL["canonical_counts"]).fetchall())


def test_walk_by_matrix_and_by_edges(spark, monkeypatch):
    import random

    r = random.Random(9)
    edges = spark.createDataFrame([(e, f"f{f}") for e in range(200) for f in {r.randrange(30) for _ in range(r.randrange(1, 5))}] + [(None, "f1"), (7, None)], "e long, f string")
    restart = spark.createDataFrame([(e,) for e in range(0, 260, 3)], "e long")  # some have no edges
    walk = lambda few, **more: monkeypatch.setattr(graph, "FEW", few) or {x.f: x.score for x in graph.bipartite_walk(edges, "e", "f", **more).collect()}
    for more in ({"iterations": 5, "tolerance": None}, {"restart": restart, "iterations": 6, "tolerance": None}):
        assert walk(1000, **more) == pytest.approx(walk(0, **more), abs=1e-12)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()  # the edges are read from the cut


def test_network_patterns_makes_few_cuts(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, keep=graph.checkpointed: cuts.append(1) or keep(df))
    sides = [spark.createDataFrame([(i, (i * k) % 7) for i in range(60) for k in range(1, 3 + own)], "e long, f long") for own in (0, 1)]
    graph.network_patterns(*sides, "e", "f", 0.01, 0.0).collect()
    assert len(cuts) < 10  # no cut for each of the walk's steps


def test_quantiles_are_exact_without_a_table_of_values(spark):
    import random

    import numpy as np

    r = random.Random(4)
    groups = {"many": [r.gauss(0, 1) for _ in range(3000)], "ties": [float(r.randrange(3)) for _ in range(500)], "far": [1e300, -1e300, *(r.random() for _ in range(400))], "one": [5.0], "two": [1.0, 2.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None)], "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {x.g: x.ends for x in metrics.quantiles(rows, ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, shares)), rel=1e-12)
    assert " percentile(" not in metrics.trimmed(rows, ["g"], "v")._jdf.queryExecution().analyzed().toString()  # that holds all distinct values of a group


def test_entities_are_dealt_before_they_are_scored(spark):
    from tessera.plans import catalog

    plan = catalog.QUERIES["all_model_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity_id") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")  # printed from the last step down


def test_candidate_units_are_sent_once_by_entity(spark):
    from tessera.plans import catalog_sets

    plan = catalog_sets._candidate_units(spark, "/root/testdata/sf0.001")[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
