"""Evaluation against a plain computation over random label sets."""

import random
import statistics

import pytest

from labelmill.operators import evaluate as ev

CLASSES = ["a", "b", "c", "d"]


def _data(n=200, seed=1):
    rng = random.Random(seed)
    names = [*CLASSES[:3], "x"]  # 'd' never occurs, 'x' is outside the classes
    pick = lambda: sorted({x for x in names if rng.random() < 0.35})
    # One slice holds most rows.
    return [(i, rng.choice(["s0"] * 8 + ["s1", "s2"]), pick(), pick()) for i in range(n)]


def _div(a, b):
    return a / b if b else 0.0


def _plain(rows):
    per = {}
    for c in CLASSES:
        tp = sum(c in t and c in p for _, _, t, p in rows)
        fp = sum(c not in t and c in p for _, _, t, p in rows)
        fn = sum(c in t and c not in p for _, _, t, p in rows)
        per[c] = (tp, fp, fn, _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn))
    tp, fp, fn = (sum(v[k] for v in per.values()) for k in range(3))
    n, support = len(rows), tp + fn
    return {
        "f1_micro": _div(2 * tp, 2 * tp + fp + fn), "precision_micro": _div(tp, tp + fp), "recall_micro": _div(tp, tp + fn),
        "precision_macro": sum(v[3] for v in per.values()) / 4, "recall_macro": sum(v[4] for v in per.values()) / 4,
        "f1_macro": sum(v[5] for v in per.values()) / 4,
        "f1_weighted": _div(sum(v[5] * (v[0] + v[2]) for v in per.values()), support),
        "hamming_loss": (fp + fn) / (n * 4),
        "exact_match_ratio": sum(set(t) == set(p) for _, _, t, p in rows) / n,
        "one_correct_accuracy": sum(bool(set(t) & set(p)) for _, _, t, p in rows) / n,
        "sample_count": float(n),
    }, per


def _df(spark, rows):
    return spark.createDataFrame(rows, "id int, src string, y_true array<string>, y_pred array<string>").repartition(5)


def test_metrics(spark):
    rows = _data()
    summary = ev.evaluation_summary(_df(spark, rows), CLASSES, slice_col="src").cache()
    got = {(r["slice"], r["metric"]): r["value"] for r in ev.metrics_long(summary).collect()}
    slices = {"all": rows, **{s: [r for r in rows if r[1] == s] for s in ("s0", "s1", "s2")}}
    plain = {s: _plain(part)[0] for s, part in slices.items()}
    for s, metrics in plain.items():
        for m, v in metrics.items():
            assert got[s, m] == pytest.approx(v, abs=1e-12), (s, m)
    assert len(got) == 44

    labels = {r["label"]: r for r in ev.per_label(summary).collect() if r["slice"] == "all"}
    for c, (tp, fp, fn, p, r_, f) in _plain(rows)[1].items():
        r = labels[c]
        assert (r["true_count"], r["pred_count"]) == (tp + fn, tp + fp)
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((p, r_, f))

    across = {r["metric"]: r for r in ev.slice_summary(summary).collect()}
    assert set(across) == set(ev.SUMMARY_METRICS)
    for m in ev.SUMMARY_METRICS:
        v = [plain[s][m] for s in ("s0", "s1", "s2")]
        assert across[m]["mean"] == pytest.approx(statistics.mean(v))
        assert across[m]["std"] == pytest.approx(statistics.pstdev(v))
        assert (across[m]["min"], across[m]["max"]) == pytest.approx((min(v), max(v)))

    ranked = sorted(("s0", "s1", "s2"), key=lambda s: (-plain[s]["f1_micro"], s))
    assert [r["slice"] for r in ev.rank_slices(summary).collect()] == ranked
    ends = {r["rank"]: r["slice"] for r in ev.best_and_worst(summary).collect()}
    assert ends["best"] == ranked[0] and plain[ends["worst"]]["f1_micro"] == min(plain[s]["f1_micro"] for s in ranked)
    order = sorted(CLASSES, key=lambda c: (-_plain(rows)[1][c][5], -(_plain(rows)[1][c][0] + _plain(rows)[1][c][2]), c))
    assert [r["label"] for r in ev.rank_labels(summary).collect()] == order
    summary.unpersist()


def test_report_samples_average(spark):
    rows = _data(50, 9)
    summary = ev.evaluation_summary(_df(spark, rows), CLASSES)
    got = {r["row"]: r for r in ev.classification_report(summary).collect()}
    inside = [({*t} & {*CLASSES}, {*p} & {*CLASSES}) for _, _, t, p in rows]
    assert got["samples avg"]["precision"] == pytest.approx(sum(_div(len(t & p), len(p)) for t, p in inside) / 50)
    assert got["samples avg"]["recall"] == pytest.approx(sum(_div(len(t & p), len(t)) for t, p in inside) / 50)
    assert got["samples avg"]["f1"] == pytest.approx(sum(_div(2 * len(t & p), len(t) + len(p)) for t, p in inside) / 50)
    assert set(got) == {*CLASSES, "micro avg", "macro avg", "weighted avg", "samples avg"}


def test_perfect_predictions(spark):
    rows = [(i, "s", t, list(reversed(t)) * 2) for i, (_, _, t, _) in enumerate(_data(40, 3)) if set(t) & set(CLASSES)]
    row = ev.metrics_wide(ev.evaluation_summary(_df(spark, rows), CLASSES[:3])).head()
    assert row["f1_micro"] == row["f1_weighted"] == row["exact_match_ratio"] == row["one_correct_accuracy"] == 1.0
    assert row["hamming_loss"] == 0.0


def test_one_slice_has_no_summary_and_no_rows_no_metrics(spark):
    rows = [(1, "s", ["a"], None), (2, "s", None, ["a"])]
    summary = ev.evaluation_summary(_df(spark, rows), CLASSES, slice_col="src")
    assert ev.slice_summary(summary).count() == 0
    assert ev.metrics_long(ev.evaluation_summary(_df(spark, rows).where("id > 5"), CLASSES)).count() == 0
    assert ev.best_and_worst(ev.evaluation_summary(_df(spark, rows), CLASSES)).count() == 0


def test_label_universe(spark):
    df = _df(spark, [(1, "s", ["b"], ["x"]), (2, "s", None, ["b"])])
    rows = {r["label"]: (r["in_true"], r["in_pred"]) for r in ev.label_universe(df, "y_true", "y_pred").collect()}
    assert rows == {"b": (1, 1), "x": (0, 1)}
    rows = {r["label"]: (r["in_true"], r["in_pred"]) for r in ev.label_universe(df, "y_true", "y_pred", ["a", "b"]).collect()}
    assert rows == {"a": (0, 0), "b": (1, 1), "x": (0, 1)}
    empty = ev.label_universe(df.where("id > 9"), "y_true", "y_pred").collect()
    assert [tuple(r) for r in empty] == [(None, 0, 0, "No labels to evaluate.")]
