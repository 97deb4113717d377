"""Data-set statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import values


def dataset_totals(df: DataFrame, labels: str) -> DataFrame:
    """Rows, label occurrences, distinct labels in one pass: each row yields itself and its labels,
    which are counted per label first, so the distinct count never gathers the occurrences."""
    itself = F.array(F.struct(F.lit(True).alias("row"), F.lit(None).cast("string").alias("label")))
    tagged = F.transform(
        F.coalesce(F.col(labels), F.array().cast("array<string>")),
        lambda x: F.struct(F.lit(False).alias("row"), x.alias("label")),
    )
    counts = df.select(F.explode(F.concat(itself, tagged)).alias("e")).select("e.*").groupBy("row", "label").agg(
        F.count("*").alias("n")
    )
    total = lambda rows: F.coalesce(F.sum(F.when(F.col("row") == rows, F.col("n"))), F.lit(0))
    return counts.agg(
        total(True).alias("n_rows"), total(False).alias("n_labels"), F.count_if(~F.col("row")).alias("n_distinct")
    )


def label_distribution(df: DataFrame, labels: str) -> DataFrame:
    """(label, n), most frequent first."""
    exploded = df.select(F.explode(labels).alias("label"))
    return exploded.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def length_stats(df: DataFrame, length) -> DataFrame:
    """Mean, exact median, population standard deviation, min and max of an integer length.

    Rows are first reduced to (length, count), which map-side aggregation shrinks to the number
    of distinct lengths; the exact median is then read from the counts.
    """
    hist = df.select(length.alias("len")).where(F.col("len").isNotNull()).groupBy("len").agg(
        F.count("*").alias("n")
    )
    total, x, n = F.sum("n"), F.col("len").cast("double"), F.col("n")
    mean = F.sum(x * n) / total
    return hist.agg(
        mean.alias("mean"),
        F.percentile("len", F.lit(0.5), n).alias("median"),
        F.sqrt(F.greatest(F.sum(x * x * n) / total - mean * mean, F.lit(0.0))).alias("std"),
        F.min("len").cast("bigint").alias("min"),
        F.max("len").cast("bigint").alias("max"),
    )


def labels_per_row(df: DataFrame, labels: str) -> DataFrame:
    return length_stats(df, F.size(labels)).select("mean", "median")


def unknown_labels(df: DataFrame, labels: str, expected: Iterable[str]) -> DataFrame:
    """Labels found but not expected, sorted."""
    known = values(df.sparkSession, expected, "label")
    return label_distribution(df, labels).select("label").join(known, "label", "left_anti").orderBy("label")
