"""Model files, selection, and batch scoring of a file."""

import json

import pytest

from tessera import api, cli
from tessera.operators import scoring


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "m").mkdir()
    for name, role in (("a", "product"), ("b", "hidden")):
        model = {"model_type": "range_motif", "model_id": name, "category": f"cat {name}", "threshold": 0.5, "role": role, "ranges": {"n_tokens": [2, 5]}, "patterns": {"has_digit": 1.0}, "weight": 0.5}
        (tmp_path / "m" / f"{name}.json").write_text(json.dumps(model))
    return str(tmp_path / "m")


def test_registry(folder, capsys):
    assert api.available_models(folder) == ["a", "b"] and api.available_models(folder, "product") == ["a"]
    models = scoring.load_models(folder)
    assert [m.model_id for m in api.select_models(models, None)] == ["a"]
    assert [m.model_id for m in api.select_models(models, ["b", "a", "b"])] == ["b", "a"]
    with pytest.raises(ValueError):
        api.select_models(models, ["c"])
    assert cli.main(["--models", folder, "--list-models"]) == 0 and capsys.readouterr().out.split() == ["a", "b"]


def test_batch_file(spark, folder, tmp_path):
    (tmp_path / "in.csv").write_text("﻿name,text\nx,two words 1\ny,\n")
    cli.main(["--models", folder, "--batch-in", str(tmp_path / "in.csv"), "--batch-out", str(tmp_path / "out")])
    rows = {r["name"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert rows["x"]["best_score"] == "1.000000" and rows["x"]["product_positive_count"] == "1"
    assert rows["y"]["best_category"] is None
    assert rows["y"]["best_decision"] == "invalid input" and rows["y"]["best_valid"] == "false" and rows["y"]["representative"] == "unresolved"
    assert len(rows["x"].asDict()) == 2 + 18


def test_one_text(spark, folder, capsys):
    from tessera.features import TextFeatures

    provider_of = lambda i, t: TextFeatures(i, t, "__category")
    models = scoring.load_models(folder)
    assert [r["model_id"] for r in api.score_all(spark, "two words 1", models, provider_of)] == ["a", "b"]
    assert api.score(spark, "two words 1", models[0], provider_of) == 1.0 and api.score(spark, " ", models[0], provider_of) is None
    with pytest.raises(TypeError):
        api.score(spark, None, models[0], provider_of)
    assert api.category_scorers(spark, models, provider_of)["cat a"]("words") == 0.0
    assert api.model_labels(folder)[1] == {"model_id": "b", "category": "cat b", "role": "hidden"}
    assert cli.main(["--models", folder, "--score", "two words 1"]) == 0 and capsys.readouterr().out.split("\t")[:3] == ["a", "cat a", "1.000000"]
    assert cli.main(["--models", folder, "--score-all", "two words 1", "--model-id", "a", "--model-id", "b"]) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["--models", folder, "--self-test"]) == 0 and capsys.readouterr().out == "ok\n"
    assert api.self_test(spark, [], provider_of) == ["no models"]


def test_jobs(spark, tmp_path, capsys):
    from tessera import jobs
    from tessera.plans import catalog

    assert not {q for names in jobs.JOBS.values() for q in names} - set(catalog.QUERIES)
    out = str(tmp_path / "catalog")
    assert jobs.main(["catalog", "--data", "/root/testdata/sf0.001", "--out", out]) == 0 and capsys.readouterr().out.split() == jobs.JOBS["catalog"]
    rows = json.loads((tmp_path / "catalog" / "manifest.json").read_text())["rows"]
    assert rows["tree_flatten"] == spark.read.parquet(f"{out}/tree_flatten").count() > 0
    assert (tmp_path / "catalog" / "report.md").read_text().startswith("# catalog\n\n## tree_flatten\n")
    with pytest.raises(ValueError, match="another run"):
        jobs.main(["ablation", "--data", "/root/testdata/sf0.001", "--out", out])
