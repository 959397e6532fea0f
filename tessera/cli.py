"""Command line: list models, score a text or a file, test the installation."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera import api
from tessera.features import TextFeatures
from tessera.operators.scoring import load_models


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description="Score texts with the models of a folder.")
    p.add_argument("--models", required=True, help="folder of model definitions (JSON)")
    p.add_argument("--list-models", action="store_true")
    p.add_argument("--model-id", action="append", help="only this model; may be repeated")
    p.add_argument("--score", metavar="TEXT", help="score one text with one model (the first public one without --model-id)")
    p.add_argument("--score-all", metavar="TEXT", help="score one text with all chosen models")
    p.add_argument("--self-test", action="store_true")
    p.add_argument("--batch-in", help="delimited file with a header")
    p.add_argument("--batch-out", help="folder for the result")
    p.add_argument("--column", help="the input column; else the first known name")
    a = p.parse_args(arguments)
    if a.list_models:
        print("\n".join(api.available_models(a.models)))
        return 0
    if not (a.batch_in and a.batch_out) and a.score is None and a.score_all is None and not a.self_test:
        p.error("--list-models, --score, --score-all, --self-test, or --batch-in and --batch-out")
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    provider_of = lambda i, t: TextFeatures(i, t, "__category")
    models = api.select_models(load_models(a.models), a.model_id)
    if a.self_test:
        wrong = api.self_test(spark, load_models(a.models), provider_of)
        print("\n".join(wrong) or "ok")
        return 1 if wrong else 0
    if a.score is not None or a.score_all is not None:
        for r in api.score_all(spark, a.score if a.score is not None else a.score_all, models[:1] if a.score is not None else models, provider_of):
            print(f"{r['model_id']}\t{r['category']}\t{r['score']:.6f}\t{r['decision']}" if r["valid"] else f"{r['model_id']}\t{r['category']}\t\t{r['decision']}")
        return 0
    api.score_file(spark, a.batch_in, a.batch_out, models, provider_of, a.column)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
