"""Multi-label evaluation.

Everything derives from one pass over (y_true, y_pred): each row yields one row-level record and
one record per label that is true or predicted.  These are summed per (slice, label) with map-side
aggregation, so a shuffle carries at most slices x labels rows per task however skewed the slices
are.  ``evaluation_summary`` folds that into one row per slice; every report below is computed from
that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import sql_strings
from labelmill.session import values

# The metrics that are summarised across slices.
SUMMARY_METRICS = (
    "f1_micro", "f1_macro", "f1_weighted", "precision_micro", "precision_macro", "recall_micro",
    "recall_macro", "hamming_loss", "exact_match_ratio", "one_correct_accuracy",
)
METRICS = (*SUMMARY_METRICS, "sample_count")

_ROW_SUMS = ("n", "exact", "hit", "sp", "sr", "sf")
_LABEL_SUMS = ("tp", "fp", "fn")
_SUMS = (*_ROW_SUMS, *_LABEL_SUMS)


def _ratio(num: str, den: str) -> str:
    """SQL: num / den as double, 0 where den is 0."""
    return f"if({den} = 0, 0D, cast({num} as double) / {den})"


def _record(label: str, **counted: str) -> str:
    """SQL struct of one record; sums that are not named are 0."""
    fields = "".join(f", '{k}', cast({counted.get(k, '0')} as double)" for k in _SUMS)
    return f"named_struct('label', cast({label} as string){fields})"


# One record for the row itself (label null) and one per label that is true or predicted.
# t and p are the true and predicted label sets, tb and pb their parts inside the evaluated classes.
_RECORDS = f"""explode(concat(
    array({_record(
        'null', n='1',
        exact='int(size(array_except(t, p)) = 0 and size(array_except(p, t)) = 0)',
        hit='int(size(array_intersect(t, p)) > 0)',
        sp=_ratio('shared', 'size(pb)'), sr=_ratio('shared', 'size(tb)'),
        sf=_ratio('2 * shared', '(size(tb) + size(pb))'),
    )}),
    transform(array_union(tb, pb), c -> {_record(
        'c', tp='int(array_contains(tb, c) and array_contains(pb, c))',
        fp='int(not array_contains(tb, c))', fn='int(not array_contains(pb, c))',
    )})))"""


def evaluation_summary(df: DataFrame, classes: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred",
                       slice_col: str | None = None, slice_type: str = "source") -> DataFrame:
    """One row for the whole data ('overall', 'all') and, with ``slice_col``, one per slice:
    (slice_type, slice, n, exact, hit, sp, sr, sf, stats array<struct<label,tp,fp,fn>> in class order).

    Labels outside ``classes`` count for exact match and one-correct only.
    """
    wanted = sql_strings(classes)
    key = f"cast(`{slice_col}` as string)" if slice_col else "cast(null as string)"
    sets = df.selectExpr(
        f"{key} as slice", f"array_distinct(coalesce(`{y_true}`, array())) as t",
        f"array_distinct(coalesce(`{y_pred}`, array())) as p",
    )
    inside = sets.selectExpr("*", f"array_intersect(t, {wanted}) as tb", f"array_intersect(p, {wanted}) as pb")
    shared = inside.selectExpr("*", "size(array_intersect(tb, pb)) as shared")
    records = shared.selectExpr("slice", f"{_RECORDS} as r").selectExpr("slice", "r.*")
    sums = [F.sum(c).alias(c) for c in _SUMS]
    per_slice = records.groupBy("slice", "label").agg(*sums)
    # From here on there are at most slices x (labels + 1) rows.
    sets = [["label"]] + ([["slice", "label"]] if slice_col else [])
    both = per_slice.groupingSets(sets, "slice", "label").agg(F.grouping("slice").alias("all"), *sums)
    stats = F.expr("collect_list(case when label is not null then struct(label, tp, fp, fn) end)")
    folded = both.groupBy("all", "slice").agg(*sums[: len(_ROW_SUMS)], stats.alias("_stats"))
    in_order = f"""transform({wanted}, c -> coalesce(
        get(filter(_stats, s -> s.label = c), 0),
        named_struct('label', c, 'tp', 0D, 'fp', 0D, 'fn', 0D)))"""
    return folded.selectExpr(
        f"if(all = 1, 'overall', '{slice_type}') as slice_type", "if(all = 1, 'all', slice) as slice", *_ROW_SUMS,
        f"{in_order} as stats",
    )


# SQL scores of one label's counts s.
_SCORES = {
    "precision": _ratio("s.tp", "(s.tp + s.fp)"),
    "recall": _ratio("s.tp", "(s.tp + s.fn)"),
    "f1": _ratio("2 * s.tp", "(2 * s.tp + s.fp + s.fn)"),
}


def _totals(summary: DataFrame) -> DataFrame:
    """Add struct ``s``: sums over the labels of tp, fp, fn and of each score, plain and weighted by support."""
    terms = {k: f"s.{k}" for k in _LABEL_SUMS}
    terms |= _SCORES
    terms |= {f"{k}_w": f"({v}) * (s.tp + s.fn)" for k, v in _SCORES.items()}
    start = ", ".join(f"'{k}', 0D" for k in terms)
    step = ", ".join(f"'{k}', acc.{k} + {v}" for k, v in terms.items())
    total = f"aggregate(stats, named_struct({start}), (acc, s) -> named_struct({step}))"
    return summary.selectExpr("*", f"{total} as s")


def _average(kind: str, how: str) -> str:
    """SQL: micro, macro or weighted average of a score from the totals s."""
    return {
        "micro": _SCORES[kind],
        "macro": _ratio(f"s.{kind}", "size(stats)"),
        "weighted": _ratio(f"s.{kind}_w", "(s.tp + s.fn)"),
    }[how]


def metrics_wide(summary: DataFrame) -> DataFrame:
    """One column per metric."""
    metrics = {f"{kind}_{how}": _average(kind, how) for kind in _SCORES for how in ("micro", "macro", "weighted")}
    metrics["hamming_loss"] = _ratio("(s.fp + s.fn)", "(n * size(stats))")
    metrics["exact_match_ratio"] = _ratio("exact", "n")
    metrics["one_correct_accuracy"] = _ratio("hit", "n")
    metrics["sample_count"] = "n"
    return _totals(summary).selectExpr("slice_type", "slice", *[f"{metrics[k]} as {k}" for k in METRICS])


def metrics_long(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Tidy (slice_type, slice, metric, value)."""
    return metrics_wide(summary).unpivot(["slice_type", "slice"], list(metrics), "metric", "value")


def per_label(summary: DataFrame) -> DataFrame:
    """(slice_type, slice, label, precision, recall, f1, true_count, pred_count)."""
    rows = summary.selectExpr("slice_type", "slice", "explode(stats) as s")
    return rows.selectExpr(
        "slice_type", "slice", "s.label", *[f"{v} as {k}" for k, v in _SCORES.items()],
        "bigint(s.tp + s.fn) as true_count", "bigint(s.tp + s.fp) as pred_count",
    )


def classification_report(summary: DataFrame) -> DataFrame:
    """(slice_type, slice, row, precision, recall, f1, support): one row per label and the micro,
    macro, weighted and samples averages."""
    labels = per_label(summary).selectExpr(
        "slice_type", "slice", "label as row", "precision", "recall", "f1", "true_count as support"
    )
    rows = {f"{how} avg": [_average(kind, how) for kind in _SCORES] for how in ("micro", "macro", "weighted")}
    rows["samples avg"] = [_ratio(c, "n") for c in ("sp", "sr", "sf")]
    entries = ", ".join(
        f"named_struct('row', '{row}', 'precision', {p}, 'recall', {r}, 'f1', {f})" for row, (p, r, f) in rows.items()
    )
    averages = _totals(summary).selectExpr(
        "slice_type", "slice", f"explode(array({entries})) as e", "bigint(s.tp + s.fn) as support"
    ).selectExpr("slice_type", "slice", "e.*", "support")
    return labels.unionByName(averages)


def slice_summary(summary: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) across the slices; empty unless there is more than one slice."""
    tidy = metrics_long(summary.where(F.col("slice_type") != "overall"), SUMMARY_METRICS)
    v = "value"
    return (
        tidy.groupBy("metric").agg(
            F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ).where(F.col("n") > 1).drop("n")
    )


def rank_slices(summary: DataFrame, metric: str = "f1_micro") -> DataFrame:
    """Slices by the metric, best first."""
    slices = metrics_wide(summary).where(F.col("slice_type") != "overall")
    return slices.select("slice", metric, "sample_count").orderBy(F.desc(metric), "slice")


def best_and_worst(summary: DataFrame, metric: str = "f1_micro") -> DataFrame:
    """('best', slice, value) and ('worst', slice, value); ties go to the first slice name."""
    slices = metrics_wide(summary).where(F.col("slice_type") != "overall")
    pick = lambda sign: F.min_by(
        F.struct("slice", F.col(metric).alias("value")), F.struct(sign * F.col(metric), "slice"))
    ends = slices.agg(pick(-1).alias("best"), pick(1).alias("worst")).where(F.col("best").isNotNull())
    named = F.array(*[F.struct(F.lit(k).alias("rank"), F.col(k)["slice"].alias("slice"), F.col(k)["value"].alias("value"))
                      for k in ("best", "worst")])
    return ends.select(F.explode(named).alias("e")).select("e.*")


def rank_labels(summary: DataFrame) -> DataFrame:
    """Labels of the overall data by (f1, true count), best first."""
    rows = per_label(summary.where(F.col("slice_type") == "overall"))
    return rows.select("label", "f1", "true_count", "pred_count").orderBy(
        F.desc("f1"), F.desc("true_count"), "label"
    )


def label_universe(df: DataFrame, y_true: str, y_pred: str, explicit: Sequence[str] | None = None) -> DataFrame:
    """(label, in_true, in_pred, error): the explicit list, extended by predictions outside it, or the
    sorted union of true and predicted labels; a single error row when there is none at all."""
    spark = df.sparkSession

    def tag(column: str, t: int, p: int) -> Column:
        labels = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(t).alias("t"), F.lit(p).alias("p")))

    tagged = F.concat(tag(y_true, 1, 0), tag(y_pred, 0, 1))
    found = df.select(F.explode(tagged).alias("e")).select("e.*").groupBy("label").agg(
        F.max("t").alias("in_true"), F.max("p").alias("in_pred")
    )
    if explicit is not None:
        listed = values(spark, explicit, "label").withColumn("listed", F.lit(1))
        found = listed.join(found, "label", "full_outer").where(
            (F.col("listed") == 1) | (F.col("in_pred") == 1)
        ).select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_true", "in_pred")])
    named = found.withColumn("error", F.lit(None).cast("string"))
    if explicit:
        return named
    none = found.agg(F.count("*").alias("n")).where(F.col("n") == 0).select(
        F.lit(None).cast("string").alias("label"), F.lit(0).alias("in_true"), F.lit(0).alias("in_pred"),
        F.lit("No labels to evaluate.").alias("error"),
    )
    return named.unionByName(none)
