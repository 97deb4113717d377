"""The four jobs on a small written data set, files to files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill import workflows as wf
from labelmill.operators.models import LabelModels
from labelmill.vocab import LABEL_CODES

MATH = "import os\ndef f{i}(x):\n    # note\n    return x * {i} + sum(range(x))\n"
GRID = "g{i} = [[0] * 9 for _ in range(9)]\nfor row in g{i}:\n    for c in row:\n        print(c)\n"
BAD = "def broken{i}(:\n"


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name in ("lb", "forum", "repos"):
        (root / name).mkdir()

    def code(day, i):
        return (MATH if day % 2 else GRID).format(i=i)

    for year in (2015, 2016):
        (root / "lb" / f"data_{year}.json").write_text(json.dumps(
            {str(d): {f"u{i}": code(d, i) for i in range(4)} | {"bad": BAD.format(i=d)} for d in range(1, 26)}))
        (root / "repos" / f"extra_repos_{year}.json").write_text(json.dumps(
            {str(d): {f"r{i}": code(d, i + 9) for i in range(2)} for d in range(1, 25)}))
    threads = {"2015": {str(d): {"puzzle_id": f"2015_{d}", "url": "u", "comments": [
        {"author": "a", "code": "old = 1", "language": "Python "}, {"author": "a", "code": code(d, 50)},
        {"author": "b", "code": code(d, 60)}]} for d in range(1, 26)}}
    (root / "forum" / "threads.json").write_text(json.dumps(threads))
    head = "Year,Day,Title,Cmnts,Thread,P1Desc,P2Desc,P1Lead,P2Lead,P1LOC,P2LOC," + ",".join(LABEL_CODES)
    lines = [head]
    for year in (2015, 2016, 2017):
        for day in range(1, 26):
            on = {"Math", "Str"} if day % 4 == 1 else {"Math"} if day % 2 else {"Grid"}
            lines.append(f"{year},{day},t,1,u,1,1,1'1,1'1,1,," + ",".join("X" if c in on else "" for c in LABEL_CODES))
    (root / "matrix.csv").write_text("\n".join(lines) + "\n")
    out = str(root / "out")
    df = wf.build_dataset(spark, str(root / "matrix.csv"), out, str(root / "lb"), str(root / "forum"), str(root / "repos"))
    return out, df


def test_build_dataset(spark, dataset):
    out, df = dataset
    counts = {r["DataSource"]: r["n"] for r in df.groupBy("DataSource").agg(F.count("*").alias("n")).collect()}
    assert counts == {"leaderboard": 200, "reddit": 50, "github": 96}
    assert df.where(F.col("Data").contains("import") | F.col("Data").contains("note") | F.col("Data").contains("old")).count() == 0
    # The year no source has stays as label rows without data, once per source; broken code stays as null.
    labelled = spark.read.parquet(f"{out}/labelled")
    assert labelled.where("Year = 2017 and Data is null").count() == 75
    assert labelled.where("Year < 2017 and Data is null and id = 'bad'").count() == 50
    assert {tuple(r["Labels"]) for r in df.where("Day = 5").select("Labels").distinct().collect()} == {("Str", "Math")}
    sizes = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 346 and set(sizes) == {"train", "val", "test"}


def values(metrics, kind="overall"):
    return {(r["slice"], r["metric"]): r["value"] for r in metrics.collect() if r["slice_type"] == kind}


def test_bag_model(spark, dataset, tmp_path):
    metrics = wf.train_bag_model(spark, f"{dataset[0]}/samples", str(tmp_path), grid=[{"c": 10.0, "max_iter": 30}])
    assert values(metrics)["all", "f1_micro"] > 0.8
    assert {s for s, _ in values(metrics, "source")} == {"leaderboard", "reddit", "github"}
    assert {s for s, _ in values(metrics, "cardinality")} <= {"single", "multi"}
    search = spark.read.parquet(f"{tmp_path}/search").collect()
    assert len(search) == 3 and all(r["best"] and json.loads(r["params"]) == {"c": 10.0, "max_iter": 30} for r in search)
    assert "Math" in {r["label"] for r in spark.read.parquet(f"{tmp_path}/per_label").where("slice = 'all'").collect()}
    assert spark.read.parquet(f"{tmp_path}/report").count() > 0
    loaded = LabelModels.load(f"{tmp_path}/models", spark)
    assert loaded.classes == LABEL_CODES and set(loaded.models) == {"Math", "Grid", "Str"}


def test_ngram_model(spark, dataset, tmp_path):
    metrics = wf.train_bag_model(spark, f"{dataset[0]}/samples", str(tmp_path), "ngram", [{"trees": 5, "depth": 5}],
                                 ["Math", "Grid"], 500)
    assert values(metrics)["all", "f1_micro"] > 0.8


def test_syntax_model(spark, dataset, tmp_path):
    metrics = wf.train_syntax_model(spark, f"{dataset[0]}/samples", str(tmp_path), trees=5)
    assert values(metrics)["all", "f1_micro"] > 0.6
    assert values(spark.read.parquet(f"{tmp_path}/val/metrics"))["all", "f1_micro"] > 0.5
    found = {r["label"] for r in spark.read.parquet(f"{tmp_path}/label_distribution").collect()}
    assert found == {"mathematical", "grid_traversal", "string_manipulation"}


def test_embedding_model(spark, dataset, tmp_path):
    def load():
        return lambda texts: np.array([[t.count("range"), t.count("return"), 1.0] for t in texts])

    metrics = wf.train_embedding_model(spark, f"{dataset[0]}/samples", str(tmp_path / "a"), load, grid=[{"trees": 5, "depth": 3}])
    assert values(metrics)["all", "f1_micro"] > 0.6
    metrics = wf.train_embedding_model(spark, f"{dataset[0]}/samples", str(tmp_path / "b"), width=8, grid=[{"trees": 5, "depth": 3}])
    assert 0.0 <= values(metrics)["all", "f1_micro"] <= 1.0
    metrics = wf.train_embedding_model(spark, f"{dataset[0]}/samples", str(tmp_path / "c"), width=8,
                                       grid=[{"trees": 5, "depth": 3}], contrastive=True)
    assert values(metrics)["all", "f1_micro"] > 0.6
