"""Writers.  All of them are distributed; subsets are filters of one partitioned write, not copies."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.text import space_tokens, token_ngrams

SAMPLE_COLUMNS = ("Year", "Day", "DataSource", "Data", "Labels")


def write_samples(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Five-column samples partitioned by split and source.  ``df`` carries a ``split`` column.

    The per-source subsets are the ``DataSource=`` directories, the cardinality subsets are
    filters on ``size(Labels)`` (see ``operators.splits.cardinality``).
    """
    df.select("split", *SAMPLE_COLUMNS).write.mode("overwrite").partitionBy("split", "DataSource").format(
        fmt
    ).save(path)


def write_labelled_table(df: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    """The full joined table, label-only rows with null Data included; lists become JSON in the CSV."""
    df.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        flat = [
            F.to_json(c).alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in df.columns
        ]
        df.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(csv_path)


def write_ngrams(df: DataFrame, path: str, n: int = 3) -> None:
    """Samples plus their n-gram lists as JSON records, partitioned by split."""
    grams = token_ngrams(space_tokens(F.col("Data")), n)
    df.withColumn("ngrams", grams).write.mode("overwrite").partitionBy("split").json(path)


def export_projection(df: DataFrame, path: str) -> None:
    """CSV of 2-D coordinates, label string and truncated snippet."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, vocabulary: DataFrame | None, path: str) -> None:
    """The fitted pipeline and, next to it, the vocabulary its feature indexes refer to."""
    model.write().overwrite().save(f"{path}/model")
    if vocabulary is not None:
        vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vocabulary")
