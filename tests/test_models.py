"""Per-label models: label assignment, fitting rules, search, save and load."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelmill.functions.text import space_tokens
from labelmill.operators import models as md
from labelmill.operators.splits import hash_split
from labelmill.plans import training
from labelmill.session import table
from labelmill.sources import sinks

CLASSES = ["left", "right", "always", "never", "once"]


@pytest.fixture(scope="module")
def train(spark):
    rows = []
    for i in range(120):
        x, y = (i * 37 % 100) / 50 - 1, (i * 53 % 100) / 50 - 1
        labels = ["always"] + (["left"] if x < 0 else ["right"]) + (["once"] if i == 5 else [])
        rows.append((i, Vectors.dense([x, y]), labels))
    return spark.createDataFrame(rows, ["id", "features", "y_true"]).repartition(4).cache()


def test_assign_labels(spark):
    rows = [([0.6, 0.5, 0.1], ["a", "b"]), ([0.3, 0.3, 0.2], ["a"]), ([0.1, 0.1, 0.05], []), ([0.0, 0.0, 0.0], []),
            ([0.0, 0.11, 0.0], ["b"])]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "i int, p array<double>")
    got = df.select("i", md.assign_labels("p", ["a", "b", "c"], 0.5).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [w for _, w in rows]


def test_skips_and_constants(train):
    fitted = md.fit_labels(train, "y_true", CLASSES, md.forest(5, 4, balanced=True), min_positives=2)
    assert set(fitted.models) == {"left", "right"} and fitted.constants == {"always": 1.0}
    rows = fitted.predict(train, 0.5).select("p", "y_pred").collect()
    for r in rows:
        assert r["p"][2] == 1.0 and r["p"][3] == r["p"][4] == 0.0 and all(0 <= x <= 1 for x in r["p"])
        assert "always" in r["y_pred"] and not {"never", "once"} & set(r["y_pred"])


def test_trainable_labels(train):
    rows = {r["label"]: (r["positives"], r["trainable"]) for r in md.trainable_labels(train, "y_true", CLASSES).collect()}
    assert rows["once"] == (1, False) and rows["never"] == (0, False) and rows["always"] == (120, True)


def test_logistic_learns(train):
    fitted = md.fit_labels(train, "y_true", CLASSES[:2], md.logistic(10.0, 50))
    good = fitted.predict(train).where(F.col("y_pred") == F.array_intersect("y_true", F.array(F.lit("left"), F.lit("right"))))
    assert good.count() > 110


def test_a_deeper_forest_than_spark_grows_is_an_error():
    with pytest.raises(ValueError):
        md.forest(5, 50)


def test_bounded_fit_and_variance_selection(spark, train):
    fitted = md.fit_labels(train, "y_true", CLASSES[:2], md.logistic(10.0, 20), max_rows=60)
    assert set(fitted.models) == {"left", "right"}
    flat = train.select("id", F.expr("id * 0.0").alias("zero"), (F.col("id") % 7).cast("double").alias("seven"))
    joined = md.feature_pipeline([], ["zero", "seven"], "joined")
    model = md.with_variance_selection(joined, joined.transform(flat), "joined")
    assert model.transform(flat).head()["features"].size == 1


def test_grid_search(train):
    grid = [{"c": 1e-9, "max_iter": 5}, {"c": 10.0, "max_iter": 50}]
    best, scores, fitted = md.grid_search(train, "id", "y_true", CLASSES[:2], md.logistic, grid)
    assert best == grid[1] and len(scores) == 6 and set(fitted.models) == {"left", "right"}
    assert len(md.expand_grid(md.FOREST_GRID)) == 24 and len(md.expand_grid(md.LOGISTIC_GRID)) == 6


def test_best_on_validation_needs_a_positive_score(train):
    none = train.where("id < 0")
    assert md.best_on_validation(train, none, "y_true", CLASSES[:2], md.logistic, [{}])[2] is None
    params, score, fitted = md.best_on_validation(train, train, "y_true", CLASSES[:2], md.logistic, [{"c": 10.0}])
    assert params == {"c": 10.0} and score > 0.9 and fitted is not None


def test_feature_pipeline_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b b"), (1, "b c"), (2, "")], "id int, text string").select(
        "id", space_tokens(F.col("text")).alias("tokens"))
    stages = [*md.fit_tfidf_stages(docs, "id", "tokens", "f1", 10, 1), md.hashed_bag("tokens", "f2", 64)]
    pipeline = md.feature_pipeline(stages, ["f1", "f2"])
    rows = [r["features"].toArray().tolist() for r in pipeline.transform(docs).orderBy("id").collect()]
    assert sorted(rows[0][3:])[-2:] == [1.0, 2.0] and sum(rows[0][3:]) == 3.0 and rows[2] == [0.0] * 67
    assert sum(x * x for x in rows[0][:3]) == pytest.approx(1.0)
    vocabulary = spark.createDataFrame([(i, t) for i, t in enumerate("abc")], "i int, term string")
    sinks.save_model(pipeline, vocabulary, str(tmp_path / "m"))
    loaded, terms = sinks.load_model(spark, str(tmp_path / "m"))
    assert [r["features"].toArray().tolist() for r in loaded.transform(docs).orderBy("id").collect()] == rows
    assert terms.count() == 3


def fitted_rows(monkeypatch, query, spark, sf) -> set:
    """The numbers of rows that the query's forests are told of, when 50 rows would be taken for a sample."""
    seen, forest = set(), md.forest

    def small(*args, **kwargs):
        build = forest(2, 3)
        return lambda n, positives: seen.add(n) or build(n, positives)

    monkeypatch.setattr(md, "forest", small)
    monkeypatch.setattr(md, "FIT_ROWS", 50, raising=False)
    query(spark, sf).collect()
    return seen


def test_syntax_forests_are_fitted_on_all_training_rows(spark, sf, monkeypatch):
    rows = table(spark, sf, "part").where(hash_split(F.col("p_partkey")) == "train").count()
    assert rows > 100 and fitted_rows(monkeypatch, training.per_label_forest_metrics, spark, sf) == {rows}


def test_ngram_forests_are_fitted_on_all_training_rows(spark, sf, monkeypatch):
    rows = table(spark, sf, "labels").where(hash_split(F.col("doc_id")) == "train").join(table(spark, sf, "documents"), "doc_id").count()
    assert rows > 55 and fitted_rows(monkeypatch, training.ngram_forest_metrics, spark, sf) == {rows}


def test_a_forest_beyond_its_rows_is_refused_and_not_fitted_on_a_part(train):
    with pytest.raises(ValueError):
        md.fit_labels(train, "y_true", CLASSES[:2], md.forest(2, 3), max_rows=60)
