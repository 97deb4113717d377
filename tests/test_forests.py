"""Forests of open depth: splits, tops and branches against Spark ML and brute force."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelmill.operators import forests as fo
from labelmill.operators import models as md

CLASSES = ["left", "right", "always", "never"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two columns of at most 32 values and a noisy label, so that trees are deep."""
    found = []
    for i in range(600):
        x, y = (i * 37 % 31) - 9, (i * 53 % 29)
        noisy = (i * i * 7919 % 13) < 3
        found.append((i, Vectors.sparse(2, [(j, float(v)) for j, v in enumerate((x, y)) if v]) if i % 2 else Vectors.dense([x, y]),
                      ["always"] + (["left"] if (x < 3) != noisy else []) + (["right"] if (x + y > 9) != noisy else [])))
    return spark.createDataFrame(found, ["id", "features", "y_true"]).repartition(3).cache()


def p(fitted, rows):
    return np.array([r["p"] for r in fitted.probabilities(rows).orderBy("id").collect()])


@pytest.mark.parametrize("held", [1 << 16, 40])
def test_one_tree_is_that_of_spark_wherever_it_is_cut(rows, monkeypatch, held):
    """A tree that tries both columns and takes every row once leaves nothing to chance; with 40 rows a task most of it is a top.
    Below depth 4 splits tie."""
    monkeypatch.setattr(fo, "_drawn", lambda setting, tree, block, n: np.ones(n, np.uint8))
    monkeypatch.setattr(fo, "TASK_ROWS", held)
    monkeypatch.setattr(fo, "PASS_NODES", 3)
    monkeypatch.setattr(fo, "PASS_PIECE", 2)
    monkeypatch.setattr(fo, "BLOCK_BYTES", 100)
    fitted = md.fit_labels(rows, "y_true", CLASSES, fo.DeepForest(1, 4))
    assert set(fitted.models) == {"left", "right"} and fitted.constants == {"always": 1.0}
    got = p(fitted, rows)
    assert (got[:, 2] == 1.0).all() and (got[:, 3] == 0.0).all()
    for i, c in enumerate(CLASSES[:2]):
        y = F.array_contains("y_true", c).cast("double")
        model = DecisionTreeClassifier(maxDepth=4, labelCol="y").fit(rows.withColumn("y", y))
        want = [r["probability"][1] for r in model.transform(rows).orderBy("id").collect()]
        assert np.abs(got[:, i] - want).max() < 1e-6
    deep = md.fit_labels(rows, "y_true", CLASSES, md.forest(1))
    branches = deep.models["left"].forest.branches
    assert branches.where("nodes > 1").agg(F.max(F.col("count_0") + F.col("count_1"))).head()[0] <= min(held, len(got))
    assert (branches.count() > 2) == (held == 40)


def test_forests_vote_alike_whatever_a_task_holds(rows, monkeypatch):
    whole = p(md.fit_labels(rows, "y_true", CLASSES, md.forest(30, balanced=True)), rows)
    monkeypatch.setattr(fo, "TASK_ROWS", 100)
    monkeypatch.setattr(fo, "SENT_ROWS", 1)
    monkeypatch.setattr(fo, "SENT_TREES", 7)
    monkeypatch.setattr(fo, "BUNDLE_BYTES", 500)
    parted = p(md.fit_labels(rows, "y_true", CLASSES, md.forest(30, balanced=True)), rows)
    assert np.abs(whole - parted).mean() < 0.05 and ((whole > 0.5) == (parted > 0.5)).mean() > 0.95


def test_the_driver_holds_no_tree_of_an_open_forest(spark, rows, tmp_path):
    """A forest of open depth is a table of branches; before, its nodes were objects of the driver's JVM."""
    fitted = md.fit_labels(rows, "y_true", CLASSES, md.forest(4))
    model = fitted.models["left"]
    assert isinstance(model, fo.ForestModel) and not hasattr(model, "_java_obj")
    assert model.forest.branches.agg(F.sum("nodes")).head()[0] > 100
    again = p(md.fit_labels(rows, "y_true", CLASSES, md.forest(4)), rows)
    fitted.save(str(tmp_path / "m"), spark)
    loaded = md.LabelModels.load(str(tmp_path / "m"), spark)
    assert (p(loaded, rows) == p(fitted, rows)).all() and (again == p(fitted, rows)).all()


def test_best_split_by_trying_all():
    rng = np.random.default_rng(3)
    binned, y = rng.integers(0, 5, (60, 6)).astype(np.uint8), rng.integers(0, 2, 60)
    drawn, node = rng.poisson(1, 60).astype(np.uint8), rng.integers(0, 3, 60)
    columns = fo.draw_columns(rng, 3, 6)
    assert all(len(set(c)) == 3 for c in columns.tolist())
    weights = np.array([1.0, 3.0])
    counts = fo.histogram(binned, np.arange(60), node, columns, y, drawn)
    which, cut, left = fo.best_splits(counts, np.tile(weights[:, None], 3), 2)
    count = lambda mask: np.bincount(y[mask], weights=drawn[mask], minlength=2)

    def purity(c):
        w = c * weights
        return (w * w).sum() / w.sum() if w.sum() else 0.0

    for k in range(3):
        best = {}
        for j, column in enumerate(columns[k]):
            for at in range(5):
                one, two = (count((node == k) & side) for side in (binned[:, column] <= at, binned[:, column] > at))
                if min(one.sum(), two.sum()) >= 2:
                    best[j, at] = purity(one) + purity(two)
        assert best[which[k], cut[k]] == pytest.approx(max(best.values()))
        assert (left[k] == count((node == k) & (binned[:, columns[k][which[k]]] <= cut[k]))).all()


def test_cuts_come_from_all_rows(spark):
    values = [0.0] * 50 + [float(v) for v in range(1, 51)] + [7.0] * 28
    rows = spark.createDataFrame([([0, 1], [v, -1.0 if i % 2 else 0.0]) for i, v in enumerate(values)], "slots array<int>, values array<double>")
    cuts = fo.fit_cuts(rows, len(values))
    assert [c for s, c in cuts if s == 1] == [-0.5]
    many = [c for s, c in cuts if s == 0]
    assert 3 < len(many) < fo.BINS and many == sorted(many) and many[0] == 0.5 and {6.5, 7.5} <= set(many)
