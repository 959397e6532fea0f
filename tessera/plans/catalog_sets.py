"""Queries of the set, pattern, similarity, graph, tree and construction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.features import TextFeatures
from tessera.operators import graph, membership, patterns, similarity, trees, validation
from tessera.plans.catalog import _BEST_KEY, PART_SQL, SCORED, part, query, scored, t
from tessera.sources import tables

_FLAGS = ["has_red", "has_bolt", "has_ring", "is_small"]


@query(
    """WITH m AS (SELECT DISTINCT user_id AS e, event_type || '-' || CAST(floor(value / 20) AS INTEGER) AS c FROM events), n AS (SELECT c, count(*) AS n FROM m GROUP BY 1),
    s AS (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM m x JOIN m y ON x.e = y.e AND x.c < y.c GROUP BY 1, 2)
    SELECT p.c AS a, q.c AS b, p.n AS n_a, q.n AS n_b, coalesce(shared, 0) AS shared, coalesce(shared, 0) / p.n AS fraction_of_a, coalesce(shared, 0) / q.n AS fraction_of_b, coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0)) AS jaccard
    FROM n p JOIN n q ON p.c < q.c LEFT JOIN s ON s.a = p.c AND s.b = q.c""",
    "fraction_of_a fraction_of_b jaccard",
)
def category_overlap(spark, d):
    rows = t(spark, d, "events").select("user_id", F.concat_ws("-", "event_type", F.floor(F.col("value") / 20).cast("int").cast("string")).alias("c"))
    return membership.overlap_matrix(rows, "user_id", "c")


@query("SELECT categories, count(*) AS entities, count(*) / sum(count(*)) OVER () AS fraction FROM (SELECT user_id, count(DISTINCT event_type || CAST(floor(value / 30) AS INTEGER)) AS categories FROM events GROUP BY 1) AS q GROUP BY 1", "fraction")
def multiplicity(spark, d):
    rows = t(spark, d, "events").select("user_id", F.concat("event_type", F.floor(F.col("value") / 30).cast("int").cast("string")).alias("c"))
    return membership.multiplicity(rows, "user_id", "c")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def set_difference(spark, d):
    orders = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return membership.difference(orders.select("o_custkey", "o_orderkey"), orders.where("o_orderstatus = 'F'"), "o_custkey", "o_orderkey")


_AUDIT_ROWS = "(SELECT p_partkey AS i, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name || '/' || p_brand END AS x, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name || '/' || (p_size % 5) END AS par FROM part)"
_AUDIT_SETS = "(SELECT p_name || '/' || p_brand AS x, p_name || '/' || (p_size % 5) AS par, CASE p_size WHEN 1 THEN 'target_positive' WHEN 2 THEN 'target_negative' ELSE 'other' END AS scope FROM part WHERE p_size <= 3)"


@query(
    f"""WITH r AS (SELECT *, CASE scope WHEN 'target_positive' THEN 1 WHEN 'target_negative' THEN 2 ELSE 3 END AS k FROM {_AUDIT_SETS} AS s),
    j AS (SELECT i, x, par, (SELECT min(k) FROM r WHERE r.x = a.x) AS ek, (SELECT min(k) FROM r WHERE r.par = a.par) AS pk, CASE WHEN par IS NULL THEN false ELSE row_number() OVER (PARTITION BY par ORDER BY i) > 1 END AS dup FROM {_AUDIT_ROWS} AS a)
    SELECT i, dup AS duplicate, CASE WHEN x IS NOT NULL THEN coalesce(CASE least(ek, pk) WHEN 1 THEN 'target_positive' WHEN 2 THEN 'target_negative' WHEN 3 THEN 'other' END, 'none') END AS overlap_scope,
      CASE WHEN x IS NOT NULL THEN CASE WHEN ek IS NOT NULL THEN 'exact' WHEN pk IS NOT NULL THEN 'parent' ELSE 'none' END END AS overlap_basis,
      CASE WHEN x IS NULL THEN 'unresolved' WHEN least(ek, pk) IS NOT NULL THEN 'overlap_excluded' WHEN dup THEN 'duplicate_external_excluded' ELSE 'true_external_candidate' END AS status FROM j"""
)
def external_audit(spark, d):
    part_rows = t(spark, d, "part")
    exact, parent = F.concat_ws("/", "p_name", "p_brand"), F.concat_ws("/", "p_name", (F.col("p_size") % 5).cast("string"))
    known = F.col("p_partkey") % 17 != 0
    rows = part_rows.select(F.col("p_partkey").alias("i"), F.when(known, exact).alias("x"), F.when(known, parent).alias("par"))
    sets = part_rows.where("p_size <= 3").select(exact.alias("x"), parent.alias("par"), F.when(F.col("p_size") == 1, "target_positive").when(F.col("p_size") == 2, "target_negative").otherwise("other").alias("scope"))
    return membership.external_audit(rows, sets, "i", "x", "par").select("i", "duplicate", "overlap_scope", "overlap_basis", "status")


@query("SELECT s_suppkey, reason FROM (SELECT *, coalesce(sum(CASE WHEN reason = 'retained' THEN 1 ELSE 0 END) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM (SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'target_label' WHEN s_acctbal < 1000 THEN 'low' ELSE 'retained' END AS reason FROM supplier) AS q) AS r WHERE k < 20")
def exclusion_reasons(spark, d):
    return membership.exclusion_reasons(t(spark, d, "supplier"), 20, "s_suppkey", {"target_label": F.col("s_nationkey") < 5, "low": F.col("s_acctbal") < 1000}).select("s_suppkey", "reason")


@query("SELECT count(*) AS row_count, 2 AS column_count, CAST(sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END + CASE WHEN trim(lang) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS exact_duplicates, count(DISTINCT text) AS distinct_first FROM documents")
def data_quality(spark, d):
    return membership.data_quality(t(spark, d, "documents"), ["text", "lang"])


@query("SELECT c_custkey, key, coalesce(status, CASE WHEN key IS NULL THEN 'missing_identifier' ELSE 'not_attempted' END) AS status FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cas:' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'name:' || c_mktsegment END AS key FROM customer) AS q LEFT JOIN (SELECT 'cas:' || n_nationkey AS k, 'resolved' AS status FROM nation WHERE n_nationkey < 12) AS c ON key = k")
def cached_resolution(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("string")).alias("cas"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("name"))
    cache = t(spark, d, "nation").where("n_nationkey < 12").select(F.concat(F.lit("cas:"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("resolved").alias("status"))
    return membership.resolve(rows, cache, "cas", "name").select("c_custkey", "key", "status")


@query("SELECT value, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END), ''), p_brand) AS value FROM part) AS q GROUP BY 1")
def coalesce_first(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_name")).alias("first"), "p_brand")
    return tables.coalesce_first(rows, ["first", "p_brand"], "p_partkey")


# -- patterns -----------------------------------------------------------------------------------------------

_LONG = f"(SELECT category, unnest(['has_red', 'has_bolt', 'has_ring', 'is_small']) AS pattern, unnest([has_red, has_bolt, has_ring, is_small]) AS hit, category = 'PROMO' AS positive FROM {PART_SQL} AS p)"
_PATTERN_RATES = f"(SELECT pattern, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) FILTER (positive) * 100 AS positive_rate, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) FILTER (NOT positive) * 100 AS negative_rate FROM {_LONG} AS l GROUP BY 1)"


def _rates(spark, d):
    return patterns.pattern_rates(part(spark, d).withColumn("positive", F.col("category") == "PROMO"), _FLAGS, "positive")


@query(f"SELECT *, positive_rate - negative_rate AS delta FROM {_PATTERN_RATES} AS r", "positive_rate negative_rate delta")
def pattern_rates(spark, d):
    return _rates(spark, d)


@query(f"SELECT pattern, positive_rate / negative_rate AS ratio, positive_rate - negative_rate AS weight FROM {_PATTERN_RATES} AS r WHERE positive_rate / negative_rate >= 0.95e0", "ratio weight")
def pattern_selection(spark, d):
    return patterns.select_by_ratio(_rates(spark, d), 0.95).select("pattern", "ratio", "weight")


@query(f"SELECT pattern, greatest(delta, 0.1e0) AS weight FROM (SELECT pattern, positive_rate - negative_rate AS delta, row_number() OVER (ORDER BY positive_rate - negative_rate DESC, pattern) AS r, count(*) FILTER (positive_rate > negative_rate) OVER () AS m FROM {_PATTERN_RATES} AS q) AS z WHERE (m > 0 AND delta > 0 AND r <= 3) OR (m = 0 AND r = 1)", "weight")
def pattern_fallback(spark, d):
    return patterns.fallback_selection(_rates(spark, d), 50.0)


_ASSESSED = f"""WITH c AS (SELECT pattern, category, count(*) FILTER (hit) AS hits, count(*) AS n FROM {_LONG} AS l GROUP BY 1, 2),
    x AS (SELECT a.*, hits / n AS rate, (SELECT max(hits / n) FROM c o WHERE o.pattern = a.pattern AND o.category <> a.category) AS max_other, (SELECT sum(hits) FROM c o WHERE o.pattern = a.pattern AND o.category <> a.category) AS oh, (SELECT sum(n) FROM c o WHERE o.pattern = a.pattern AND o.category <> a.category) AS onn, (SELECT count(*) FROM c o WHERE o.pattern = a.pattern AND o.category <> a.category AND hits / n >= 0.01e0) AS breadth FROM c a)
    SELECT *, rate - max_other AS gap, greatest(rate - max_other, 0) * log2(1 + enrichment) * sqrt(rate) AS quality FROM (SELECT pattern, category, hits, n, rate, max_other, breadth, CAST(oh AS DOUBLE) / onn AS negative_rate, ((hits + 0.5e0) / (n + 1)) / ((oh + 0.5e0) / (onn + 1)) AS enrichment FROM x) AS y"""


@query(_ASSESSED, "rate max_other negative_rate enrichment gap quality")
def pattern_assessment(spark, d):
    return patterns.assess(part(spark, d), _FLAGS, "category")


@query(
    f"""SELECT pattern, category, CASE WHEN reason = '' AND place > 1 THEN 'max_patterns' ELSE reason END AS rejection_reason, reason = '' AND place <= 1 AS selected, CASE WHEN reason = '' AND place > 1 THEN 0e0 ELSE quality END AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY reason <> '', quality DESC, rate DESC, pattern) AS place FROM (
    SELECT *, array_to_string(list_filter([CASE WHEN NOT breadth <= 6 THEN 'category_breadth' END, CASE WHEN NOT enrichment >= 1.01e0 THEN 'enrichment' END, CASE WHEN NOT quality > 0 THEN 'nonpositive_quality' END, CASE WHEN NOT hits >= 30 THEN 'positive_count' END, CASE WHEN NOT rate >= 0.01e0 THEN 'positive_prevalence' END, CASE WHEN NOT gap >= 0.001e0 THEN 'specificity_gap' END], lambda x: x IS NOT NULL), ';') AS reason FROM ({_ASSESSED}) AS a) AS b) AS c""",
    "weight",
)
def pattern_gates(spark, d):
    rows = patterns.assess(part(spark, d), _FLAGS, "category")
    return patterns.gate_patterns(rows, ["category"], 30, 0.01, 1.01, 0.001, 6, 1).select("pattern", "category", "rejection_reason", "selected", "weight")


@query("SELECT s_suppkey, array_to_string(list_sort(list_filter([CASE WHEN NOT s_acctbal >= 0 THEN 'negative_balance' END, CASE WHEN NOT s_nationkey < 15 THEN 'far' END, CASE WHEN NOT s_acctbal < 8000 THEN 'large' END], lambda x: x IS NOT NULL)), ';') AS failures FROM supplier")
def gate_reasons(spark, d):
    gates = {"negative_balance": F.col("s_acctbal") >= 0, "far": F.col("s_nationkey") < 15, "large": F.col("s_acctbal") < 8000}
    return t(spark, d, "supplier").select("s_suppkey", patterns.reasons(gates).alias("failures"))


_UNITS = "(SELECT p_type AS category, p_partkey AS e, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS unit FROM part)"
_CANDIDATES = f"""(SELECT category, unit, n, share, breadth, share / greatest(coalesce(other, 0), 1e0 / total) AS enrichment FROM (
    SELECT a.category, a.unit, a.n, a.n / z.total AS share, z.total, count(*) OVER (PARTITION BY a.unit) AS breadth, (SELECT max(o.n / y.total) FROM (SELECT category, unit, count(DISTINCT e) AS n FROM {_UNITS} AS u GROUP BY 1, 2) o JOIN (SELECT p_type, count(*) AS total FROM part GROUP BY 1) y ON y.p_type = o.category WHERE o.unit = a.unit AND o.category <> a.category) AS other
    FROM (SELECT category, unit, count(DISTINCT e) AS n FROM {_UNITS} AS u GROUP BY 1, 2) a JOIN (SELECT p_type, count(*) AS total FROM part GROUP BY 1) z ON z.p_type = a.category) AS q
  WHERE n >= 5 AND share >= 0.02e0 AND breadth <= 6 AND share / greatest(coalesce(other, 0), 1e0 / total) >= 0.9e0)"""


def _candidates(spark, d):
    rows = t(spark, d, "part")
    units = rows.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("category"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("unit"))
    return patterns.unit_candidates(units, rows.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("total")), 5, 0.02, 6, 0.9)


@query(f"SELECT * FROM {_CANDIDATES} AS c", "share enrichment")
def unit_candidates(spark, d):
    return _candidates(spark, d)


_METHODS = "(SELECT 'word' AS method, p_partkey AS e, p_type AS category, unnest(string_split(p_name, ' ')) AS unit FROM part UNION ALL SELECT 'brand', p_partkey, p_type, p_brand FROM part UNION ALL SELECT 'hybrid', p_partkey, p_type, unnest(string_split(p_name, ' ') || [p_brand]) FROM part)"


@query(
    f"""WITH u AS (SELECT DISTINCT * FROM {_METHODS} AS m), kept AS (SELECT method, unit FROM u GROUP BY 1, 2 HAVING count(*) >= 40), k AS (SELECT u.* FROM u JOIN kept USING (method, unit)), c AS (SELECT method, category, unit FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 12),
    b AS (SELECT method, unit, (SELECT count(*) FROM c WHERE c.method = kept.method AND c.unit = kept.unit) AS b FROM kept), z AS (SELECT DISTINCT p_type AS category FROM part),
    j AS (SELECT m.method, avg(CASE WHEN n > 0 THEN s / n ELSE 0 END) AS jac FROM (SELECT m.method, x.category AS a, y.category AS bb, (SELECT count(*) FROM c p JOIN c q USING (method, unit) WHERE p.method = m.method AND p.category = x.category AND q.category = y.category) AS s, (SELECT count(DISTINCT unit) FROM c WHERE c.method = m.method AND c.category IN (x.category, y.category)) AS n FROM (SELECT DISTINCT method FROM kept) m, z x, z y WHERE x.category < y.category) AS m GROUP BY 1)
    SELECT b.method, count(*) AS units, avg(CASE WHEN b = 1 THEN 1e0 ELSE 0e0 END) AS exclusive, avg(CASE WHEN b > 1 THEN 1e0 ELSE 0e0 END) AS shared, avg(CASE WHEN b >= 3 THEN 1e0 ELSE 0e0 END) AS in_three, avg(b) AS mean_breadth, max((SELECT count(DISTINCT e) FROM k WHERE k.method = b.method)) AS coverage, max(jac) AS mean_pairwise_jaccard, (SELECT count(*) FROM part) AS entities,
      max((SELECT count(DISTINCT e) FROM k WHERE k.method = b.method)) / (SELECT count(*) FROM part) AS coverage_fraction FROM b JOIN j USING (method) GROUP BY 1""",
    "exclusive shared in_three mean_breadth mean_pairwise_jaccard coverage_fraction",
)
def candidate_summary(spark, d):
    rows, units = _candidate_units(spark, d)
    retained = units.groupBy("method", "unit").agg(F.count("*").alias("n")).where("n >= 40")
    return patterns.candidate_summary(units, retained, rows.groupBy("category").agg(F.count("*").alias("total")), 12)


def _candidate_units(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("category"), F.split("p_name", " ").alias("word"), F.array("p_brand").alias("brand"))
    # entities are dealt before their units are taken out, so that equal units of an entity meet without being sent
    rows = rows.withColumn("hybrid", F.array_union("word", "brand")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity_id")
    return rows, rows.select("entity_id", "category", F.explode(F.create_map(*(x for m in ("word", "brand", "hybrid") for x in (F.lit(m), F.col(m)))))).select("entity_id", "category", F.col("key").alias("method"), F.explode("value").alias("unit")).distinct()


@query("SELECT pattern, count(DISTINCT model_id) AS models, count(DISTINCT category) AS categories, string_agg(DISTINCT model_id, ';' ORDER BY model_id) AS model_ids, string_agg(DISTINCT category, ';' ORDER BY category) AS category_names, count(DISTINCT model_id) > 1 AS shared FROM (SELECT p_name AS pattern, p_brand AS model_id, p_type AS category FROM part) AS q GROUP BY 1")
def pattern_reuse(spark, d):
    return patterns.reuse(t(spark, d, "part").select(F.col("p_name").alias("pattern"), F.col("p_brand").alias("model_id"), F.col("p_type").alias("category")))


@query(
    r"""SELECT doc_id AS entity_id, source AS category, canon <> '' AS valid, CAST(length(text) AS DOUBLE) AS n_chars, CAST(len(tokens) AS DOUBLE) AS n_tokens, length(replace(canon, ' ', '')) / CAST(greatest(len(tokens), 1) AS DOUBLE) AS mean_token, length(regexp_replace(text, '[^A-Z]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS upper_ratio, length(regexp_replace(text, '[^0-9]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) AS digit_ratio,
    regexp_matches(text, '[0-9]') AS has_digit, contains(text, '!') AS has_exclaim, contains(text, '|') AS has_bar, contains(text, '?') AS has_question, regexp_matches(text, 'licen[cs]e', 'i') AS has_license,
    CAST(len(list_distinct(tokens)) AS INTEGER) AS n_features, CAST(CASE WHEN len(tokens) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) END AS INTEGER) AS n_fragments, sha256(canon) AS group_key
    FROM (SELECT *, CASE WHEN canon = '' THEN [] ELSE string_split(canon, ' ') END AS tokens FROM (SELECT doc_id, source, coalesce(text, '') AS text, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))) AS canon FROM documents) AS x) AS y""",
    "mean_token upper_ratio digit_ratio",
)
def text_entities(spark, d):
    rows = TextFeatures().entities(t(spark, d, "documents"))
    return rows.select("entity_id", "category", "valid", *TextFeatures.PROPS, *TextFeatures.FLAGS, F.size("features").alias("n_features"), F.size("fragments").alias("n_fragments"), "group_key")


# -- similarity ---------------------------------------------------------------------------------------------

_VEC = "(SELECT vec_id, label, list_filter(range(1, 65), lambda i: embedding[i] > 0.1) AS f FROM embeddings)"
_PAIRS = f"(SELECT a.vec_id AS a, b.vec_id AS b, b.label AS label, len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))) AS s FROM {_VEC} AS a JOIN {_VEC} AS b ON a.label <> 0 AND b.label = 0 AND len(list_intersect(a.f, b.f)) > 0)"


def _vectors(spark, d):
    f = F.expr("filter(transform(sequence(1, 64), i -> if(element_at(embedding, i) > 0.1D, i, null)), x -> x is not null)")
    return t(spark, d, "embeddings").select("vec_id", "label", f.alias("features"))


@query(f"SELECT v.vec_id, coalesce(max(s), 0) AS max_similarity FROM {_VEC} AS v LEFT JOIN {_PAIRS} AS p ON p.a = v.vec_id WHERE v.label <> 0 GROUP BY 1", "max_similarity")
def max_similarity(spark, d):
    v = _vectors(spark, d)
    return similarity.max_similarity(v.where("label <> 0"), v.where("label = 0"), "vec_id", "vec_id", "features")


@query(f"SELECT vec_id FROM {_VEC} AS v WHERE label <> 0 AND vec_id NOT IN (SELECT a FROM {_PAIRS} AS p WHERE s >= 0.45e0)")
def keep_unlike(spark, d):
    v = _vectors(spark, d)
    return similarity.keep_unlike(v.where("label <> 0"), v.where("label = 0"), "vec_id", "vec_id", "features", 0.45).select("vec_id")


_NEAREST = f"""WITH p AS (SELECT a.vec_id AS a, b.label AS c, max(len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)))) AS s FROM {_VEC} AS a JOIN {_VEC} AS b ON a.label >= 5 AND b.label < 5 AND len(list_intersect(a.f, b.f)) > 0 GROUP BY 1, 2)
    SELECT v.vec_id, (SELECT c FROM p WHERE a = v.vec_id ORDER BY s DESC, list_position([3, 1, 4, 0, 2], c) LIMIT 1) AS nearest, coalesce((SELECT max(s) FROM p WHERE a = v.vec_id), 0) AS similarity FROM {_VEC} AS v WHERE v.label >= 5"""


def _nearest(spark, d):
    v = _vectors(spark, d)
    return similarity.nearest_category(v.where("label >= 5"), v.where("label < 5"), "vec_id", "vec_id", "features", "label", [3, 1, 4, 0, 2])


@query(_NEAREST, "similarity")
def nearest_category(spark, d):
    return _nearest(spark, d)


@query(f"SELECT nearest, len(l) AS n, l[len(l) // 2 + 1] AS median FROM (SELECT nearest, list_sort(list(similarity)) AS l FROM ({_NEAREST}) AS q GROUP BY 1) AS z", "median")
def nearest_category_summary(spark, d):
    return similarity.upper_median(_nearest(spark, d), ["nearest"], "similarity")


_L2 = "WITH s AS (SELECT quantile_cont(p_size, 0.5) AS c1, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS s1, quantile_cont(p_retailprice, 0.5) AS c2, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS s2 FROM part WHERE p_type = 'PROMO')"


@query(f"{_L2} SELECT p_partkey AS entity_id, sqrt(power((p_size - c1) / s1, 2) + power((p_retailprice - c2) / s2, 2)) AS distance FROM part, s WHERE p_type <> 'PROMO' ORDER BY distance, entity_id LIMIT 50", "distance")
def property_matched_l2(spark, d):
    rows = part(spark, d)
    return similarity.matched_l2(rows.where("category <> 'PROMO'"), rows.where("category = 'PROMO'"), "entity_id", ["p_size", "p_retailprice"], 50)


@query(
    """WITH a AS (SELECT list_sort(list(CAST(p_size AS DOUBLE))) AS u, list_sort(list(p_retailprice)) AS v, count(*) AS n FROM part WHERE p_type = 'PROMO'),
    s AS (SELECT u[n // 2 + 1] AS c1, greatest(u[CAST(floor(0.75e0 * (n - 1)) AS BIGINT) + 1] - u[CAST(floor(0.25e0 * (n - 1)) AS BIGINT) + 1], 1) AS s1, v[n // 2 + 1] AS c2, greatest(v[CAST(floor(0.75e0 * (n - 1)) AS BIGINT) + 1] - v[CAST(floor(0.25e0 * (n - 1)) AS BIGINT) + 1], 1) AS s2 FROM a)
    SELECT p_partkey AS entity_id, (abs(p_size - c1) / s1 + abs(p_retailprice - c2) / s2) / 2 AS distance FROM part, s WHERE p_type <> 'PROMO' ORDER BY distance, length(CAST(p_partkey AS VARCHAR)), p_partkey * 7919 % 1000003 LIMIT 50""",
    "distance",
)
def property_matched_l1(spark, d):
    rows = part(spark, d).withColumn("ordinal", F.col("entity_id") * 7919 % 1000003)
    return similarity.matched_l1(rows.where("category <> 'PROMO'"), rows.where("category = 'PROMO'"), "entity_id", ["p_size", "p_retailprice"], 50, "ordinal")


@query(
    """WITH z AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_name) AS r, sum(n) OVER (ORDER BY n DESC, p_name) AS upto, sum(n) OVER () AS total FROM z)
    SELECT count(*) AS clusters, CAST(max(total) AS BIGINT) AS items, max(n) / max(total) AS largest_share, CAST(min(r) FILTER (upto >= 0.5e0 * total) AS INTEGER) AS for_half, CAST(min(r) FILTER (upto >= 0.8e0 * total) AS INTEGER) AS for_most FROM r""",
    "largest_share",
)
def cluster_structure(spark, d):
    return similarity.cluster_structure(t(spark, d, "part").select("p_name"), "p_name")


@query()
def neighbour_clusters(spark, d):
    return similarity.set_clusters(_vectors(spark, d), "vec_id", "features", 0.4)


@query("WITH s AS (SELECT p_type AS m, list(DISTINCT p_name) FILTER (p_size > 40) AS f FROM part GROUP BY 1) SELECT a.m AS a, b.m AS b, CASE WHEN len(list_distinct(list_concat(a.f, b.f))) = 0 THEN 1e0 ELSE len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f))) END AS jaccard FROM s a JOIN s b ON a.m < b.m", "jaccard")
def model_pattern_jaccard(spark, d):
    sets = t(spark, d, "part").groupBy(F.col("p_type").alias("m")).agg(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_name"))).alias("f"))
    return similarity.pairwise_jaccard(sets, [], "m", "f")


# -- graph, trees -------------------------------------------------------------------------------------------


def _walk_sql(steps: int) -> str:
    parts = ["e AS (SELECT DISTINCT o_custkey AS e, l_partkey AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey)", "k AS (SELECT e, f, count(*) OVER (PARTITION BY e) AS de, count(*) OVER (PARTITION BY f) AS df FROM e)", "x0 AS (SELECT e, 1e0 / count(*) OVER () AS x, 1e0 / count(*) OVER () AS p FROM (SELECT DISTINCT e FROM e) AS q)", "y0 AS (SELECT DISTINCT f, 0e0 AS y FROM e)"]
    for i in range(steps):
        parts.append(f"y{i + 1} AS (SELECT f, 0.85e0 * sum(x / de) AS y FROM k JOIN x{i} USING (e) GROUP BY 1)")
        parts.append(f"x{i + 1} AS (SELECT x.e, 0.15e0 * x.p + 0.85e0 * coalesce(g, 0) AS x, x.p FROM x{i} x LEFT JOIN (SELECT e, sum(y / df) AS g FROM k JOIN y{i} USING (f) GROUP BY 1) AS h USING (e))")
    return f"WITH {', '.join(parts)} SELECT f, y / sum(y) OVER () AS score FROM y{steps}"


@query(_walk_sql(6), "score", digits=9)
def bipartite_pagerank(spark, d):
    edges = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("e"), F.col("l_partkey").alias("f"))
    return graph.bipartite_walk(edges, "e", "f", iterations=6, tolerance=None)


@query()
def network_patterns(spark, d):
    edges = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("e"), F.concat_ws(" ", "p_name", "p_brand").alias("f"), "l_returnflag")
    return graph.network_patterns(edges.where("l_returnflag = 'R'"), edges.where("l_returnflag <> 'R'"), "e", "f", 0.0005, 1.0, 24)


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth, r_name AS path, false AS is_leaf FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || ' > ' || n_name, NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 's' || s_suppkey, 2, r_name || ' > ' || n_name || ' > ' || s_name, true FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tree_flatten(spark, d):
    region = t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("name"))
    nation = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("up"), F.col("n_name").alias("name"))
    supplier = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("up"), F.col("s_name").alias("name"))
    return trees.flatten(region.unionAll(nation).unionAll(supplier), "id", "up", "name")


# -- construction and validation ----------------------------------------------------------------------------

_PROPS = f"(SELECT category = 'PROMO' AS positive, unnest(['p_retailprice', 'p_size']) AS property, unnest([p_retailprice, p_size]) AS v FROM {PART_SQL} AS p)"


@query(
    f"""WITH h AS (SELECT property, v, sum(CASE WHEN positive THEN 1e0 ELSE 0e0 END) AS p, sum(CASE WHEN positive THEN 0e0 ELSE 1e0 END) AS n FROM {_PROPS} AS q GROUP BY 1, 2), c AS (SELECT property, abs(sum(p) OVER w / sum(p) OVER a - sum(n) OVER w / sum(n) OVER a) AS g FROM h WINDOW w AS (PARTITION BY property ORDER BY v DESC), a AS (PARTITION BY property))
    SELECT property, ks, low, high FROM (SELECT property, max(g) AS ks FROM c GROUP BY 1) AS k JOIN (SELECT property, quantile_cont(v, 0.1) AS low, quantile_cont(v, 0.9) AS high FROM {_PROPS} AS q WHERE positive GROUP BY 1) AS e USING (property)""",
    "ks low high",
)
def fit_properties(spark, d):
    return validation.fit_properties(part(spark, d).withColumn("positive", F.col("category") == "PROMO"), ["p_retailprice", "p_size"], "positive")


_GRID = f"""(WITH s AS (SELECT CAST(k AS DOUBLE) / 20 AS w, positive, round(CAST(k AS DOUBLE) / 20 * score + (1 - CAST(k AS DOUBLE) / 20) * (doc_id % 7) / 7e0, 9) AS score FROM {SCORED} AS z, range(0, 21) AS r(k)),
    h AS (SELECT w, score, CAST(count(*) FILTER (positive) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT positive) AS DOUBLE) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER a AS pos, sum(n) OVER a AS neg FROM h WINDOW d AS (PARTITION BY w ORDER BY score DESC), a AS (PARTITION BY w)),
    r AS (SELECT *, (tp / pos + (neg - fp) / neg) / 2 AS ba, CASE WHEN (tp + fp) * pos * neg * (pos + neg - tp - fp) > 0 THEN (tp * (neg - fp) - fp * (pos - tp)) / sqrt((tp + fp) * pos * neg * (pos + neg - tp - fp)) ELSE 0 END AS mcc FROM c),
    x AS (SELECT w, score, ba, mcc FROM r UNION ALL SELECT w, nextafter(max(score), CAST('Infinity' AS DOUBLE)), 0.5e0, 0e0 FROM r GROUP BY w)
    SELECT w, auc, threshold, balanced_accuracy, mcc FROM (SELECT w, sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) AS auc FROM r GROUP BY w) AS a JOIN (SELECT w, arg_max(score, {_BEST_KEY}) AS threshold, max(ba) AS balanced_accuracy, arg_max(mcc, {_BEST_KEY}) AS mcc FROM x GROUP BY w) AS b USING (w))"""


def _grid(spark, d):
    rows = scored(spark, d).select("positive", F.col("score").alias("first"), ((F.col("doc_id") % 7) / F.lit(7.0)).alias("second"))
    return validation.weight_grid(rows, [], "first", "second", "positive")


@query(f"SELECT * FROM {_GRID} AS g", "w auc threshold balanced_accuracy mcc")
def weight_grid(spark, d):
    return _grid(spark, d)


@query(f"SELECT arg_max(w, (round(auc, 12), round(balanced_accuracy, 12), -w)) AS w, max(auc) AS auc FROM {_GRID} AS g", "w auc")
def best_weight(spark, d):
    return validation.best_weight(_grid(spark, d), [])


@query("SELECT p_type, min(g) AS least_gain, avg(g) AS mean_gain, avg(o) AS mean_original, min(g) > 0 AND avg(g) >= 0.02e0 AND avg(o) >= -0.02e0 AS promoted FROM (SELECT p_type, p_size % 3 AS fold, avg(p_size) / 1000e0 AS g, avg(p_retailprice) / 10000e0 - 0.11e0 AS o FROM part GROUP BY 1, 2) AS q GROUP BY 1", "least_gain mean_gain mean_original")
def fold_gate(spark, d):
    deltas = t(spark, d, "part").groupBy("p_type", (F.col("p_size") % 3).alias("fold")).agg((F.avg("p_size") / F.lit(1000.0)).alias("g"), (F.avg("p_retailprice") / F.lit(10000.0) - F.lit(0.11)).alias("o"))
    return validation.folds_gate(deltas, ["p_type"], "g", "o")


@query("SELECT c_custkey, failures, failures = '' AS promoted FROM (SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'balance' END, CASE WHEN NOT c_nationkey <> 3 THEN 'nation' END, CASE WHEN NOT c_mktsegment <> 'HOUSEHOLD' THEN 'segment' END], lambda x: x IS NOT NULL), ';') AS failures FROM customer) AS q")
def promotion_gate(spark, d):
    gates = {"balance": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") != 3, "segment": F.col("c_mktsegment") != "HOUSEHOLD"}
    return validation.promotion(t(spark, d, "customer"), gates).select("c_custkey", "failures", "promoted")


@query(
    f"""SELECT * FROM (SELECT p_partkey AS entity_id, 'all_other' AS regime FROM part WHERE p_type <> 'PROMO' ORDER BY sha256(concat('neg|', p_partkey)), CAST(p_partkey AS VARCHAR) LIMIT 30) AS a UNION ALL
    SELECT entity_id, 'property_matched' FROM ({_L2} SELECT p_partkey AS entity_id, sqrt(power((p_size - c1) / s1, 2) + power((p_retailprice - c2) / s2, 2)) AS distance FROM part, s WHERE p_type <> 'PROMO' ORDER BY distance, entity_id LIMIT 30) AS b"""
)
def negative_regimes(spark, d):
    return validation.negative_regimes(part(spark, d), F.col("category") == "PROMO", "entity_id", ["p_size", "p_retailprice"], 30, "neg")


@query("WITH v AS (SELECT p_brand, p_type, avg(p_size) AS m FROM part GROUP BY 1, 2) SELECT v.p_brand, v.p_type, v.m, v.m - b.m AS delta_m FROM v LEFT JOIN v b ON b.p_brand = v.p_brand AND b.p_type = 'ECONOMY'", "m delta_m")
def delta_to_baseline(spark, d):
    rows = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("m"))
    return validation.delta_to_baseline(rows, ["p_brand"], "p_type", "ECONOMY", ["m"])


@query("SELECT key, CASE WHEN n < 25 THEN 'insufficient_positive_examples' WHEN a IS NULL OR b IS NULL THEN 'build_failed' WHEN released THEN 'existing_release_line' WHEN a >= 0.9e0 AND b >= 0.8e0 AND n >= 100 THEN 'strong_release_candidate' WHEN a >= 0.8e0 AND b >= 0.75e0 AND n >= 100 THEN 'release_candidate' WHEN a >= 0.7e0 THEN 'experimental_revisit' ELSE 'reject_for_now' END AS decision FROM (SELECT p_brand || '/' || (p_partkey % 13) AS key, count(*) * (min(p_partkey) % 13) AS n, CASE WHEN min(p_partkey) % 7 <> 0 THEN 0.6e0 + (min(p_partkey) % 5) * 0.1e0 END AS a, max(p_size) / 60e0 AS b, min(p_partkey) % 6 = 0 AS released FROM part GROUP BY 1) AS q")
def build_decision(spark, d):
    least = F.min("p_partkey")
    rows = t(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", (F.col("p_partkey") % 13).cast("string")).alias("key")).agg((F.count("*") * (least % 13)).alias("n"), F.when(least % 7 != 0, F.lit(0.6) + (least % 5) * F.lit(0.1)).alias("a"), (F.max("p_size") / F.lit(60.0)).alias("b"), (least % 6 == 0).alias("released"))
    return rows.select("key", validation.decision_label(F.col("a"), F.col("b"), F.col("n"), F.col("released")).alias("decision"))


_ABL = f"(SELECT lang, positive, unnest(['score', 'second']) AS component, unnest([score, round((doc_id % 7) / 7e0, 9)]) AS v FROM {SCORED} AS s)"


@query(
    f"""WITH h AS (SELECT lang, component, v AS score, CAST(count(*) FILTER (positive) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT positive) AS DOUBLE) AS n FROM {_ABL} AS a GROUP BY 1, 2, 3), c AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER a AS pos, sum(n) OVER a AS neg FROM h WINDOW d AS (PARTITION BY lang, component ORDER BY score DESC), a AS (PARTITION BY lang, component)),
    r AS (SELECT *, (CASE WHEN pos > 0 THEN tp / pos ELSE 0 END + CASE WHEN neg > 0 THEN (neg - fp) / neg ELSE 0 END) / 2 AS ba, CASE WHEN (tp + fp) * pos * neg * (pos + neg - tp - fp) > 0 THEN (tp * (neg - fp) - fp * (pos - tp)) / sqrt((tp + fp) * pos * neg * (pos + neg - tp - fp)) ELSE 0 END AS mcc FROM c),
    x AS (SELECT lang, component, score, ba, mcc FROM r UNION ALL SELECT lang, component, nextafter(max(score), CAST('Infinity' AS DOUBLE)), max(CASE WHEN neg > 0 THEN 0.5e0 ELSE 0e0 END), 0e0 FROM r GROUP BY 1, 2)
    SELECT lang, component, auc, threshold, balanced_accuracy, mcc FROM (SELECT lang, component, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(p * (neg - fp + n / 2)) / (max(pos) * max(neg)) ELSE 0e0 END AS auc FROM r GROUP BY 1, 2) AS a JOIN (SELECT lang, component, arg_max(score, {_BEST_KEY}) AS threshold, max(ba) AS balanced_accuracy, arg_max(mcc, {_BEST_KEY}) AS mcc FROM x GROUP BY 1, 2) AS b USING (lang, component)""",
    "auc threshold balanced_accuracy mcc",
)
def component_ablation(spark, d):
    rows = scored(spark, d).withColumn("second", F.round((F.col("doc_id") % 7) / F.lit(7.0), 9))
    return validation.ablation(rows, ["lang"], ["score", "second"], "positive")


@query("SELECT p_type, count(x) AS n FROM (SELECT p_type, 1 AS x FROM part WHERE p_size < 10 UNION ALL SELECT p_type, 1 FROM part WHERE p_size > 40) AS q GROUP BY 1")
def union_of_sources(spark, d):
    rows = t(spark, d, "part")
    return tables.union_by_name([rows.where("p_size < 10").select("p_type", "p_size"), rows.where("p_size > 40").select("p_type", "p_brand")]).groupBy("p_type").agg(F.count("*").alias("n"))
