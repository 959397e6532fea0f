"""Command line of staged jobs: each runs its queries over a folder of tables and writes their results and a report.

    python -m tessera.jobs audit --data TABLES --out FOLDER
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tessera import reports
from tessera.plans import catalog, catalog_reports, catalog_sets  # noqa: F401  (the others register their queries in the first)
from tessera.sources.tables import guard_output, write_json

#: job -> the queries whose results make it up, in the order of its report
JOBS = {
    "audit": ["model_ranking", "rank_within_role", "top_categories", "all_model_rollup"],
    "pattern-overlap": ["pattern_reuse", "model_pattern_jaccard"],
    "pattern-candidates": ["unit_candidates", "candidate_pool", "candidate_summary"],
    "validate": ["hash_split", "split_leakage", "pattern_assessment", "pattern_gates", "fit_properties", "negative_regimes", "frozen_model_grid", "frozen_model", "frozen_model_evaluation", "paired_bootstrap", "method_dominance", "pattern_stability", "promotion_gate"],
    "build": ["pattern_rates", "pattern_selection", "range_motif_grid", "grid_objective", "trimmed_moments", "half_gaussian_fit", "merged_priors"],
    "catalog": ["tree_flatten", "canonical_counts", "build_decision"],
    "cross-category": ["cross_category_matrix", "recalibration", "worst_source", "publication_decision"],
    "ablation": ["component_ablation", "weight_grid", "best_weight"],
    "bootstrap": ["bootstrap_auc", "paired_bootstrap"],
    "external": ["external_audit", "external_summary", "parent_coverage", "tail_likelihood_ratio"],
    "evidence": ["evidence_families", "evidence_panel_families", "cluster_medoids"],
    "reporting": ["recommended_mode", "reporting_policy", "supporting_panels", "best_and_baseline", "regime_matrix", "reporting_table"],
}


def run(spark: SparkSession, job: str, data: str, out: str, limit: int = 200) -> list[str]:
    """Writes each query's rows as Parquet, and report.md, into a folder that holds no other run; the names written."""
    guard_output(out, json.dumps({"job": job, "data": data}, sort_keys=True), [data])
    tables = {}
    for name in JOBS[job]:
        catalog.QUERIES[name](spark, data).write.mode("overwrite").parquet(f"{out}/{name}")
        tables[name] = spark.read.parquet(f"{out}/{name}")
    with open(f"{out}/report.md", "w") as f:
        f.write(reports.markdown(job, tables, limit))
    write_json(f"{out}/manifest.json", {"job": job, "data": data, "rows": {name: rows.count() for name, rows in tables.items()}})
    return list(tables)


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera.jobs", description=__doc__.splitlines()[0])
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--data", required=True, help="folder of Parquet tables")
    p.add_argument("--out", required=True, help="folder for the results; must hold no other run")
    p.add_argument("--report-rows", type=int, default=200, help="rows of each table in the report; results are whole")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    print("\n".join(run(spark, a.job, a.data, a.out, a.report_rows)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
