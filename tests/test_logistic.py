"""Many logistic models in the same passes, against dense numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelmill.operators import logistic as lg
from labelmill.operators import models as md

WIDTH, ROWS = 400, 240


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    places = [np.sort(rng.choice(WIDTH - 50, 6, replace=False)) for _ in range(ROWS)]
    values = [rng.integers(1, 4, 6).astype(float) for _ in range(ROWS)]
    x = np.zeros((ROWS, WIDTH + 1))
    for i, (s, v) in enumerate(zip(places, values)):
        x[i, s] = v
    x[:, -1] = 1
    y = (x @ rng.normal(size=(WIDTH + 1, 2)) > 0)
    return places, values, x, y, rng.integers(0, 3, ROWS)


def packed(spark, data, parts):
    places, values, _, y, fold = data
    rows = [([int(a) for a in s], [float(a) for a in v], [bool(a) for a in b], int(k))
            for s, v, b, k in zip(places, values, y, fold)]
    return lg.pack(spark.createDataFrame(rows, "slots array<int>, values array<double>, labels array<boolean>, fold int").repartition(
        parts), WIDTH)


def test_loss_and_gradient(spark, data, monkeypatch):
    monkeypatch.setattr(lg, "_PIECE", 64)
    _, _, x, y, fold = data
    blocks = packed(spark, data, 5)
    used = lg.used_slots(blocks)
    assert used[-1] == WIDTH and set(used) == set(np.flatnonzero(x.any(axis=0)))
    label, left_out = np.array([0, 1, 1]), np.array([-1, 0, 2])
    point = np.random.default_rng(1).normal(size=(len(used), 3))
    margin, inside = x[:, used] @ point, fold[:, None] != left_out
    loss, gradient = lg.evaluate(blocks, used, point, label, left_out)
    p = 1 / (1 + np.exp(-margin))
    assert np.allclose(loss, (np.logaddexp(0, np.where(y[:, label], -margin, margin)) * inside).sum(axis=0))
    assert np.allclose(gradient, x[:, used].T @ ((p - y[:, label]) * inside))
    _, curve = lg.evaluate(blocks, used, point, label, left_out, curvature=True)
    assert np.allclose(curve, (x[:, used] ** 2).T @ (p * (1 - p) * inside))


def optimum(x, y, c, steps=60):
    """Newton's method on the dense problem."""
    n, w = len(x), np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, 1 / (c * n)), 1e-12]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x / n + np.diag(penalty), x.T @ (p - y) / n + penalty * w)
    return w


def test_all_models_reach_their_optimum(spark, data):
    _, _, x, y, fold = data
    used = np.flatnonzero(x.any(axis=0))
    specs = [lg.Spec(i, k, lg.Logistic(c, 500, 1e-6)) for i in (0, 1) for k in (-1, 0, 1, 2) for c in (0.1, 1.0)]
    counts = {k: int((fold == k).sum()) for k in range(3)}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lg, "STALL", 0.0)
        found = [lg.fit_all(packed(spark, data, parts), WIDTH, specs, counts) for parts in (1, 7)]
    for spec in specs:
        inside = fold != spec.fold
        want = optimum(x[inside][:, used], y[inside, spec.label], spec.settings.c)
        for models in found:  # whatever the partitions
            assert np.abs(models[spec].dense()[used] - want).max() < 0.01 * (1 + np.abs(want).max())


def test_models_that_stop_early_share_a_search(spark, data):
    short, long = lg.Logistic(10.0, 2), lg.Logistic(10.0, 50)
    specs = [lg.Spec(0, -1, short), lg.Spec(0, -1, long)]
    found = lg.fit_all(packed(spark, data, 3), WIDTH, specs, {0: ROWS})
    assert not np.allclose(found[specs[0]].dense(), found[specs[1]].dense())


def test_groups_of_models_do_not_change_them(spark, data, monkeypatch):
    specs = [lg.Spec(i, -1, lg.Logistic(1.0, 30)) for i in (0, 1)]
    blocks = packed(spark, data, 3)
    whole = lg.fit_all(blocks, WIDTH, specs, {0: ROWS})
    monkeypatch.setattr(lg, "PASS_COEFFICIENTS", 1)
    alone = lg.fit_all(blocks, WIDTH, specs, {0: ROWS})
    for spec in specs:
        assert np.allclose(whole[spec].dense(), alone[spec].dense(), atol=1e-6)


def test_folds_constants_and_rare_classes(spark):
    rows = [(i, Vectors.sparse(8, [i % 2, 2 + i % 3], [1.0, 1.0]), ["odd"] * (i % 2) + ["every"] + ["once"] * (i == 4), i % 3)
            for i in range(60)] + [(60, Vectors.dense([0.0] * 8), ["every"], 0), (61, Vectors.sparse(8, [], []), ["every"], 1)]
    df = spark.createDataFrame(rows, ["id", "features", "y_true", "part"])
    found = md.fit_logistic(df, "y_true", ["odd", "every", "once", "never"], [md.logistic(10.0, 30)], folds="part")
    assert sorted(found) == [0, 1, 2]
    assert all(set(found[k][0].constants) == {"every"} and "never" not in found[k][0].models for k in found)
    assert "once" in found[0][0].models and "once" not in found[1][0].models
    models = md.fit_labels(df, "y_true", ["odd", "every"], md.logistic())
    out = models.predict(df).where("id < 60")
    assert out.where(F.array_contains("y_pred", "odd") != (F.col("id") % 2 == 1)).count() == 0
    assert out.where(~F.array_contains("y_pred", "every")).count() == 0


def test_save_and_load(spark, tmp_path, data):
    rows = [(i, Vectors.sparse(5, [i % 5], [2.0]), ["a"] if i % 5 < 2 else ["b"]) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "features", "y_true"])
    fitted = md.fit_labels(df, "y_true", ["a", "b", "c"], md.logistic())
    fitted.save(str(tmp_path / "m"), spark)
    loaded = md.LabelModels.load(str(tmp_path / "m"), spark)
    p = lambda m: [r["p"] for r in m.probabilities(df).orderBy("id").collect()]
    assert np.allclose(p(fitted), p(loaded)) and loaded.classes == ["a", "b", "c"]


def test_empty_training_set(spark):
    df = spark.createDataFrame([(1, Vectors.dense([1.0]), ["a"])], ["id", "features", "y_true"]).where("id = 0")
    assert md.fit_labels(df, "y_true", ["a"], md.logistic()).models == {}
    best, scores, _ = md.grid_search(df, "id", "y_true", ["a"], md.logistic, [{"c": 1.0}], refit=False)
    assert [s for *_, s in scores] == [0.0] * 3
