"""Registered queries: evaluation and data-set statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import string_array
from labelmill.operators import evaluate as ev
from labelmill.operators import stats
from labelmill.operators.labels import marked_columns
from labelmill.operators.splits import cardinality
from labelmill.plans.inputs import EVAL_CLASSES, EVAL_CTE, predictions, rounded
from labelmill.session import table


def _summary(spark, sf, by_source: bool = False) -> DataFrame:
    return ev.evaluation_summary(
        predictions(spark, sf), EVAL_CLASSES, slice_col="source" if by_source else None
    )


def _picked(spark, sf, *names: str) -> DataFrame:
    return rounded(ev.metrics_wide(_summary(spark, sf)).select(*names), *names)


def eval_hamming(spark, sf):
    return _picked(spark, sf, "hamming_loss")


PRF = ("precision_micro", "precision_macro", "recall_micro", "recall_macro", "f1_micro", "f1_macro", "f1_weighted")


def eval_prf(spark, sf):
    return _picked(spark, sf, *PRF)


def eval_exact_match(spark, sf):
    return _picked(spark, sf, "exact_match_ratio")


def eval_one_correct(spark, sf):
    return _picked(spark, sf, "one_correct_accuracy")


def eval_per_label(spark, sf):
    rows = ev.per_label(_summary(spark, sf)).drop("slice_type", "slice")
    return rounded(rows, "precision", "recall", "f1")


def eval_report(spark, sf):
    rows = ev.classification_report(_summary(spark, sf)).drop("slice_type", "slice")
    return rounded(rows, "precision", "recall", "f1")


def eval_label_universe(spark, sf):
    return ev.label_universe(predictions(spark, sf), "y_true", "y_pred", EVAL_CLASSES)


def eval_by_source(spark, sf):
    return rounded(ev.metrics_long(_summary(spark, sf, True)), "value")


def eval_source_summary(spark, sf):
    return rounded(ev.slice_summary(_summary(spark, sf, True)), "mean", "std", "min", "max")


def eval_best_worst(spark, sf):
    return rounded(ev.best_and_worst(_summary(spark, sf, True)), "value")


def eval_label_rank(spark, sf):
    return rounded(ev.rank_labels(_summary(spark, sf)), "f1")


def eval_slice_rank(spark, sf):
    return rounded(ev.rank_slices(_summary(spark, sf, True)), "f1_micro", "sample_count")


def eval_by_cardinality(spark, sf):
    df = predictions(spark, sf).withColumn("card", cardinality(F.col("y_true"))).where(F.col("card").isNotNull())
    summary = ev.evaluation_summary(df, EVAL_CLASSES, slice_col="card", slice_type="cardinality")
    only = summary.where(F.col("slice_type") == "cardinality")
    return rounded(ev.metrics_long(only).drop("slice_type"), "value")


# ---- statistics ------------------------------------------------------------------------------

KNOWN = ["quality", "fr", "en", "missing"]


def _tagged(spark, sf) -> DataFrame:
    """Documents with the label list [quality?, toxic?, lang]."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    tags = F.concat(marked_columns(["quality", "toxic"], 1), F.array("lang"))
    return joined.select("doc_id", "n_chars", tags.alias("labels"))


def dataset_totals(spark, sf):
    return stats.dataset_totals(_tagged(spark, sf), "labels")


def label_distribution(spark, sf):
    return stats.label_distribution(_tagged(spark, sf), "labels")


def length_stats(spark, sf):
    docs = table(spark, sf, "documents").select(F.length("text").alias("n"))
    return rounded(stats.length_stats(docs, F.col("n")), "mean", "median", "std")


def labels_per_row(spark, sf):
    return rounded(stats.labels_per_row(_tagged(spark, sf), "labels"), "mean", "median")


def unknown_labels(spark, sf):
    return stats.unknown_labels(_tagged(spark, sf), "labels", KNOWN)


def cardinality_subsets(spark, sf):
    df = _tagged(spark, sf).withColumn("subset", cardinality(F.array_except("labels", string_array(["en"]))))
    return df.where(F.col("subset").isNotNull()).select("subset", "doc_id", F.size("labels").cast("bigint").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_hamming, eval_prf, eval_per_label, eval_exact_match, eval_one_correct, eval_report,
        eval_label_universe, eval_by_source, eval_source_summary, eval_best_worst, eval_label_rank,
        eval_slice_rank, eval_by_cardinality, dataset_totals, label_distribution, length_stats,
        labels_per_row, unknown_labels, cardinality_subsets,
    )
}


def _r(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)


def _overall(*names: str) -> str:
    return EVAL_CTE + f"SELECT {_r(*names)} FROM wide WHERE slice_type = 'overall'"


TAGGED_CTE = """
WITH tagged AS (
  SELECT d.doc_id, d.n_chars, length(d.text) AS len,
         list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, lang],
                     lambda x: x IS NOT NULL) AS labels
  FROM documents d LEFT JOIN labels l USING (doc_id)),
one AS (SELECT doc_id, unnest(labels) AS label FROM tagged)
"""

ORACLES = {
    "eval_hamming": _overall("hamming_loss"),
    "eval_prf": _overall(*PRF),
    "eval_exact_match": _overall("exact_match_ratio"),
    "eval_one_correct": _overall("one_correct_accuracy"),
    "eval_per_label": EVAL_CTE + """
SELECT label, round(p::DOUBLE, 6) AS precision, round(r::DOUBLE, 6) AS recall, round(f::DOUBLE, 6) AS f1,
       (tp + fn)::BIGINT AS true_count, (tp + fp)::BIGINT AS pred_count
FROM lab WHERE slice_type = 'overall'""",
    "eval_report": EVAL_CTE + """,
per_doc AS (
  SELECT doc_id, sum(y * yhat) AS hits, sum(y) AS nt, sum(yhat) AS np
  FROM sliced WHERE slice_type = 'overall' AND label <> 'other' GROUP BY doc_id),
rows AS (
  SELECT label AS row, p AS precision, r AS recall, f AS f1, (tp + fn)::BIGINT AS support
  FROM lab WHERE slice_type = 'overall'
  UNION ALL SELECT 'micro avg', precision_micro, recall_micro, f1_micro, support::BIGINT
  FROM wide WHERE slice_type = 'overall'
  UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, support::BIGINT
  FROM wide WHERE slice_type = 'overall'
  UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, support::BIGINT
  FROM wide WHERE slice_type = 'overall'
  UNION ALL SELECT 'samples avg', avg(CASE WHEN np = 0 THEN 0 ELSE hits / np::DOUBLE END),
    avg(CASE WHEN nt = 0 THEN 0 ELSE hits / nt::DOUBLE END),
    avg(CASE WHEN nt + np = 0 THEN 0 ELSE 2 * hits / (nt + np)::DOUBLE END), sum(nt)::BIGINT FROM per_doc)
SELECT row, round(precision::DOUBLE, 6) AS precision, round(recall::DOUBLE, 6) AS recall,
       round(f1::DOUBLE, 6) AS f1, support FROM rows""",
    "eval_label_universe": EVAL_CTE + """
SELECT label, max(y)::INT AS in_true, max(yhat)::INT AS in_pred, NULL::VARCHAR AS error FROM every GROUP BY label
HAVING label <> 'other' OR max(yhat) = 1""",
    "eval_by_source": EVAL_CTE + "SELECT slice_type, slice, metric, round(value, 6) AS value FROM tidy",
    "eval_source_summary": EVAL_CTE + """
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
       round(max(value), 6) AS max
FROM tidy WHERE slice_type = 'source' AND metric <> 'sample_count' GROUP BY metric HAVING count(*) > 1""",
    "eval_best_worst": EVAL_CTE + """,
ranked AS (SELECT slice, f1_micro, row_number() OVER (ORDER BY f1_micro DESC, slice) AS hi,
                  row_number() OVER (ORDER BY f1_micro, slice) AS lo
           FROM wide WHERE slice_type = 'source')
SELECT 'best' AS rank, slice, round(f1_micro::DOUBLE, 6) AS value FROM ranked WHERE hi = 1
UNION ALL SELECT 'worst', slice, round(f1_micro::DOUBLE, 6) FROM ranked WHERE lo = 1""",
    "eval_label_rank": EVAL_CTE + """
SELECT label, round(f::DOUBLE, 6) AS f1, (tp + fn)::BIGINT AS true_count, (tp + fp)::BIGINT AS pred_count
FROM lab WHERE slice_type = 'overall' ORDER BY f DESC, true_count DESC, label""",
    "eval_slice_rank": EVAL_CTE + """
SELECT slice, round(f1_micro::DOUBLE, 6) AS f1_micro, sample_count FROM wide WHERE slice_type = 'source'
ORDER BY f1_micro DESC, slice""",
    "eval_by_cardinality": EVAL_CTE.replace(
        "sliced AS (", """cards AS (
  SELECT doc_id, CASE WHEN sum(y) = 1 THEN 'single' ELSE 'multi' END AS card FROM every GROUP BY doc_id
  HAVING sum(y) > 0),
sliced AS (
  SELECT 'cardinality' AS slice_type, card AS slice, doc_id, label, y, yhat FROM every JOIN cards USING (doc_id)),
unsliced AS (""") + "SELECT slice, metric, round(value, 6) AS value FROM tidy",
    "dataset_totals": TAGGED_CTE + """
SELECT (SELECT count(*) FROM tagged) AS n_rows, count(*) AS n_labels, count(DISTINCT label) AS n_distinct FROM one""",
    "label_distribution": TAGGED_CTE + "SELECT label, count(*) AS n FROM one GROUP BY label ORDER BY n DESC, label",
    "length_stats": TAGGED_CTE + """
SELECT round(avg(len), 6) AS mean, round(median(len)::DOUBLE, 6) AS median, round(stddev_pop(len), 6) AS std,
       min(len)::BIGINT AS min, max(len)::BIGINT AS max FROM tagged""",
    "labels_per_row": TAGGED_CTE + """
SELECT round(avg(len(labels)), 6) AS mean, round(median(len(labels))::DOUBLE, 6) AS median FROM tagged""",
    "unknown_labels": TAGGED_CTE + """
SELECT DISTINCT label FROM one WHERE label NOT IN ('quality', 'fr', 'en', 'missing') ORDER BY label""",
    "cardinality_subsets": TAGGED_CTE + """
SELECT CASE WHEN k = 1 THEN 'single' ELSE 'multi' END AS subset, doc_id, len(labels)::BIGINT AS n
FROM (SELECT *, len(list_filter(labels, lambda x: x <> 'en')) AS k FROM tagged) WHERE k > 0""",
}
