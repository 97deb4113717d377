"""Registered queries: label assignment and the trained models' metrics.

Models are fitted on the train side of the hash split and scored on the test side.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.hashing import hash_bucket
from labelmill.functions.text import code_tokens, ngram_strings, space_tokens
from labelmill.operators import evaluate as ev
from labelmill.operators import models as md
from labelmill.operators import trees as tr
from labelmill.operators.splits import hash_split
from labelmill.plans.inputs import EVAL_CLASSES, part_code, predictions, rounded
from labelmill.session import spread, table

SEARCH_WIDTH = 1 << 14  # hashed tokens of the models of a search: 36 of them share a pass
SCORED = ["alpha", "beta", "gamma", "delta"]


def threshold_labels(spark, sf):
    """Hash scores in tenths, scaled down for two thirds of the documents so that every branch is met."""
    scale = F.get(F.array(F.lit(1.0), F.lit(0.4), F.lit(0.1)), (F.col("doc_id") % 3).cast("int"))
    tenth = lambda seed: F.floor(hash_bucket(F.col("doc_id"), seed) / 1000) / 10
    p = F.array(*[F.round(tenth(seed) * scale, 3) for seed in range(4)])
    docs = table(spark, sf, "documents").select("doc_id", p.alias("p"))
    return docs.select("doc_id", F.concat_ws(",", md.assign_labels("p", SCORED, 0.5)).alias("labels"))


def trainable_labels(spark, sf):
    return md.trainable_labels(predictions(spark, sf), "y_true", EVAL_CLASSES)


def _bag_rows(spark, sf, tokens, width: int) -> DataFrame:
    """(doc_id, source, split, y_true, features): hashed bag of words of the labelled documents, in one scan.  Tokens are hashed before
    the labels are joined, so no text is shuffled."""
    bag = md.hashed_bag("tokens", "features", width)
    rows = predictions(spark, sf, F.col("features"), prepare=lambda docs: bag.transform(docs.withColumn("tokens", tokens(F.col("text")))))
    return md.materialise(rows.select("doc_id", "source", "y_true", "features", hash_split(F.col("doc_id")).alias("split")))


def _scores(df: DataFrame, classes, slice_col: str | None = None) -> DataFrame:
    summary = ev.evaluation_summary(df, classes, slice_col=slice_col)
    return rounded(ev.metrics_long(summary), "value")


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def bow_logreg_metrics(spark, sf):
    train, test = _parts(_bag_rows(spark, sf, code_tokens, md.BAG_WIDTH))
    fitted = md.fit_labels(train, "y_true", EVAL_CLASSES, md.logistic())
    return _scores(fitted.predict(test), EVAL_CLASSES)


def ngram_forest_metrics(spark, sf):
    train, test = _parts(_bag_rows(spark, sf, lambda t: ngram_strings(space_tokens(t)), md.FOREST_WIDTH))
    fitted = md.fit_labels(train, "y_true", EVAL_CLASSES, md.forest(md.NGRAM_TREES))
    return _scores(fitted.predict(test), EVAL_CLASSES)


def grid_search_scores(spark, sf):
    """Three-fold scores of the logistic grid, all models fitted in the same passes over bags of ``SEARCH_WIDTH`` places."""
    train, _ = _parts(_bag_rows(spark, sf, code_tokens, SEARCH_WIDTH))
    grid = md.expand_grid(md.LOGISTIC_GRID)
    best, scores, _ = md.grid_search(train, "doc_id", "y_true", EVAL_CLASSES, md.logistic, grid, refit=False)
    rows = [(g, k, float(p["c"]), p["max_iter"], round(s, 6), p == best) for g, k, p, s in scores]
    return spark.createDataFrame(rows, "point int, fold int, c double, max_iter int, f1_macro double, best boolean")


SYNTAX_CLASSES = ["bare", "documented", "importing", "broken", "printing"]


def _syntax_rows(spark, sf) -> DataFrame:
    """Templated code with its form as label, and the three blocks of syntax-tree features."""
    form = (F.col("p_partkey") % 5).cast("int")
    names = F.array(*[F.lit(c) for c in SYNTAX_CLASSES])
    labels = F.array_compact(F.array(F.get(names, form), F.when(form < 3, "valid")))
    code = part_code(spark, sf).withColumn("y_true", labels)
    trees = tr.parse_trees(code, "code", "p_partkey", "y_true")
    tree = F.col("tree")
    rows = trees.select(
        "p_partkey", "y_true", tr.path_fragments(tree).alias("paths"), tr.node_type_words(tree).alias("types"),
        F.coalesce(tr.structural_keys(tree), F.array().cast("array<string>")).alias("shape"),
        hash_split(F.col("p_partkey")).alias("split"),
    )
    return md.materialise(rows)


def per_label_forest_metrics(spark, sf):
    rows = _syntax_rows(spark, sf)
    train = rows.where(F.col("split") == "train")
    stages = [
        *md.fit_tfidf_stages(train, "p_partkey", "paths", "f_paths", 7500, 2),
        *md.fit_tfidf_stages(train, "p_partkey", "types", "f_types", 7500, 2),
        md.hashed_bag("shape", "f_shape", md.FOREST_WIDTH),
    ]
    pipeline = md.feature_pipeline(stages, ["f_paths", "f_types", "f_shape"])
    featured = md.materialise(pipeline.transform(rows).select("p_partkey", "split", "y_true", "features"))
    train, test = _parts(featured)
    classes = [*SYNTAX_CLASSES, "valid", "unused"]
    build = md.forest(md.SYNTAX_TREES, md.SYNTAX_DEPTH, md.SYNTAX_MIN_SPLIT, balanced=True)
    fitted = md.fit_labels(train, "y_true", classes, build, min_positives=2)
    return _scores(fitted.predict(test, md.SYNTAX_THRESHOLD), classes)


def embedding_forest_metrics(spark, sf):
    """Forests on the dense vectors, chosen on the validation side by weighted F1."""
    labels = F.array(F.concat(F.lit("g"), (F.col("label") % 3).cast("string")),
                     F.when(F.col("label") >= 5, "high").otherwise("low"))
    rows = md.materialise(spread(table(spark, sf, "embeddings")).select(
        "vec_id", labels.alias("y_true"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        hash_split(F.col("vec_id")).alias("split")))
    train, test = _parts(rows)
    classes = ["g0", "g1", "g2", "high", "low"]
    grid = [{"trees": md.EMBEDDING_TREES, "depth": md.EMBEDDING_DEPTH, "min_split": md.EMBEDDING_MIN_SPLIT}]
    _, _, fitted = md.best_on_validation(train, rows.where(F.col("split") == "val"), "y_true", classes, md.forest, grid)
    fitted = fitted or md.LabelModels(classes)
    return _scores(fitted.predict(test), classes)


QUERIES = {
    f.__name__: f
    for f in (
        threshold_labels, trainable_labels, bow_logreg_metrics, ngram_forest_metrics, grid_search_scores,
        per_label_forest_metrics, embedding_forest_metrics,
    )
}

_TENTH = "floor((('0x' || substr(md5('{i}:' || doc_id), 1, 8))::BIGINT % 10000) / 1000) / 10"
_P = ", ".join(
    f"round({_TENTH.format(i=i)} * [1.0::DOUBLE, 0.4::DOUBLE, 0.1::DOUBLE][doc_id % 3 + 1], 3)" for i in range(4)
)
ORACLES = {
    "threshold_labels": f"""
WITH p AS (SELECT doc_id, [{_P}] AS p, ['alpha', 'beta', 'gamma', 'delta'] AS c FROM documents)
SELECT doc_id, CASE WHEN list_max(p) >= 0.5 THEN
    concat_ws(',', CASE WHEN p[1] >= 0.5 THEN c[1] END, CASE WHEN p[2] >= 0.5 THEN c[2] END,
              CASE WHEN p[3] >= 0.5 THEN c[3] END, CASE WHEN p[4] >= 0.5 THEN c[4] END)
  WHEN list_max(p) > 0.1 THEN c[list_position(p, list_max(p))] ELSE '' END AS labels FROM p""",
    "trainable_labels": """
WITH t AS (SELECT d.lang, l.* FROM documents d JOIN labels l USING (doc_id)),
n AS (SELECT 'english' AS label, count(*) FILTER (lang = 'en') AS positives FROM t
  UNION ALL SELECT 'quality', sum(quality)::BIGINT FROM t UNION ALL SELECT 'toxic', sum(toxic)::BIGINT FROM t
  UNION ALL SELECT 'unused', 0)
SELECT label, positives, positives >= 2 AS trainable FROM n""",
}
