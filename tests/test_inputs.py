"""Category inputs, snapshots, number styles and reports."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera import reports
from tessera.operators import validation
from tessera.sources import inputs


def test_categories(spark, tmp_path):
    (tmp_path / "a__positive.csv").write_text("smiles\n x\nX\n\ny\n")
    (tmp_path / "b__positive.tsv").write_text("id\tsmiles\n1\tz\n2\tx\n")
    (tmp_path / "c__positive.csv").write_text("smiles\n\" \"\n")
    paths = inputs.category_files(str(tmp_path / "*__positive.*"))
    assert list(paths) == ["a", "b", "c"]
    low = lambda c: F.lower(F.trim(c))
    with pytest.raises(ValueError, match="c$"):
        inputs.load_categories(spark, paths, low)
    with pytest.raises(FileNotFoundError, match="no1.*no2"):
        inputs.load_categories(spark, {"p": "/no1", "q": "/no2"}, low)
    paths.pop("c")
    rows, invalid, digests = inputs.load_categories(spark, paths, low)
    assert sorted(map(tuple, rows.collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")]
    assert digests["a"] == hashlib.sha256((tmp_path / "a__positive.csv").read_bytes()).hexdigest()
    assert {r.category: r.invalid for r in invalid.collect()}["b"] == 0
    found = inputs.category_map(spark, str(tmp_path / "[ab]__positive.*"))
    assert sorted((r.category, r.value) for r in found.collect()) == [("a", "X"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")]


def test_snapshots(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps({"nodes": [{"id": 1, "name": "root", "children": [2, 3]}, {"id": 2, "name": "n", "count": 7}, {"id": 3, "name": "m"}]}))
    assert sorted(map(tuple, inputs.read_tree(spark, str(tmp_path / "tree.json")).collect())) == [("1", None, "root", None), ("2", "1", "n", 7), ("3", "1", "m", None)]
    (tmp_path / "ids.txt").write_text("12\n x\n12\n 9 \n\n")
    ids = inputs.read_ids(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.id for r in ids.collect()) == [9, 12]
    values = spark.createDataFrame([(9, "C"), (9, "C"), (12, None), (5, "N")], "id long, value string")
    assert [tuple(r) for r in inputs.with_values(ids, values).collect()] == [(9, "C")]
    assert inputs.read_optional(spark, str(tmp_path / "none.csv"), "a string, b double").count() == 0
    (tmp_path / "some.csv").write_text("b,c\n1.5,x\nbad,y\n")
    assert [tuple(r) for r in inputs.read_optional(spark, str(tmp_path / "some.csv"), "a string, b double").collect()] == [(None, 1.5), (None, None)]


def test_number_styles(spark):
    df = spark.createDataFrame([(0.1234565,), (2.0,), (float("nan"),)], "x double")
    got = {s: [r[0] for r in df.select(inputs.rendered("x", s)).collect()] for s in ("fixed6", "general12", "round4", "short4")}
    assert got["fixed6"][:2] == ["0.123456", "2.000000"] and got["general12"] == ["0.1234565", "2", "nan"]
    assert got["round4"][:2] == ["0.1235", "2.0"] and got["short4"][:2] == ["0.1235", "2"]


def test_reports(spark):
    text = reports.markdown("Title", {"t": spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "k string, v double")}, most=1)
    assert text.splitlines() == ["# Title", "", "## t", "", "| k | v |", "|-|-|", "| a\\|b | 0.5000 |", "", "Only the first 1 of 2 rows."]
    result = {"valid": True, "role": "product", "category": "x", "score": 0.7, "threshold": 0.5, "margin": 0.2, "decision": "likely x", "matched_patterns": ["p", "q"]}
    assert reports.result_text([result]).splitlines() == ["Likely categories: x", "x: 0.7000 (threshold 0.5000, margin +0.2000) - likely x", "  matched: p; q"]
    assert reports.result_text([result | {"valid": False}]) == "The input is invalid.\n"


def test_split_sizes_and_regimes(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], float(i), [i % 5, 10 + i % 7]) for i in range(90)], "k long, c string, x double, f array<long>")
    validation.require_split_sizes(rows.withColumn("split", F.lit("train")), ["c"], "split", ["train"], 30)
    with pytest.raises(ValueError, match="test"):
        validation.require_split_sizes(rows.withColumn("split", F.lit("train")), ["c"], "split", ["train", "test"], 2)
    got = validation.four_regimes(rows, F.col("c") == "a", "k", ["x"], 10, "s", "f", 0.5)
    names = {r.regime: r.n for r in got.groupBy("regime").agg(F.count("*").alias("n")).collect()}
    assert names == {"all_other_random": 10, "related_hard": 10, "property_matched": 10, "distant_other": 10}
    assert got.join(rows.where("c = 'a'"), "k").count() == 0
    near = got.where("regime = 'distant_other'").join(rows, "k").collect()
    own = [set(r.f) for r in rows.where("c = 'a'").collect()]
    assert all(max(len(set(r.f) & o) / len(set(r.f) | o) for o in own) < 0.5 for r in near) or not near


def test_bootstrap_of_five_metrics(spark):
    df = spark.createDataFrame([("a", i / 60, i % 60 > 25 + (i * 11) % 17) for i in range(120)], "g string, score double, positive boolean")
    got = {r.metric: r for r in validation.bootstrap_metrics(df, ["g"], 0.5, 300, 3).collect()}
    assert set(got) == {"auc", "average_precision", "balanced_accuracy", "sensitivity", "specificity"}
    assert all(r.low <= r.mid <= r.high for r in got.values())
    true = df.where("positive").selectExpr("avg(cast(score >= 0.5 as double))").first()[0]
    assert got["sensitivity"].low <= true <= got["sensitivity"].high
