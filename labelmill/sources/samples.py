"""Readers and normalisers of labelled samples and of the wide label matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.arrays import let
from labelmill.functions.text import is_nonblank, strip_space
from labelmill.sources import json_ranges as jr
from labelmill.vocab import LABEL_CODES, MATRIX_HEAD_DDL

SPLITS = ("train", "val", "test")


def read_label_matrix(spark: SparkSession, path: str, marks: list[str] | None = None) -> DataFrame:
    """The wide CSV with one column per mark; ``marks`` are the mark column names in file order."""
    marks = LABEL_CODES if marks is None else marks
    ddl = MATRIX_HEAD_DDL + "".join(f", `{m}` string" for m in marks)
    return spark.read.csv(path, header=True, schema=ddl)


def json_label_list(text: Column) -> Column:
    """A JSON list of labels as array<string>; null for anything else."""
    return F.when(strip_space(text).startswith("["), F.from_json(text, "array<string>"))


def clean_labels(labels: Column) -> Column:
    """Drop null and blank labels; a missing or emptied list becomes ['Unknown']."""
    kept = F.filter(F.coalesce(labels, F.array().cast("array<string>")), is_nonblank)
    return let(kept, lambda k: F.when(F.size(k) == 0, F.array(F.lit("Unknown"))).otherwise(k))


def normalise_samples(df: DataFrame, data: Column, labels: Column, *keep: str) -> DataFrame:
    """Rows (keep..., code, labels): blank code dropped, labels cleaned.  ``labels`` is array<string>."""
    return (
        df.select(*keep, data.alias("code"), clean_labels(labels).alias("labels"))
        .where(is_nonblank(F.col("code")))
    )


def parse_label_text(text: Column) -> Column:
    """Labels given as text: a JSON list is decoded, anything else is split at commas and trimmed.
    Empty parts are dropped, null text gives an empty list."""
    parts = F.filter(F.transform(F.split(text, ","), strip_space), lambda x: x != "")
    return F.coalesce(json_label_list(text), parts, F.array().cast("array<string>"))


def read_records(spark: SparkSession, path: str, lines: bool = False, splittable: bool = False) -> DataFrame:
    """One row per JSON record as ``r: map<string,variant>``, whatever its keys and types.

    ``lines`` reads one record per line and splits large files; otherwise each file holds one list, which
    ``splittable`` reads by byte ranges.
    """
    if splittable:
        listed = jr.members(jr.fragments(spark, path), 1).where("opens = '['")
        return listed.selectExpr("from_json(text, 'map<string,variant>') as r").where("r is not null")
    if lines:
        return spark.read.text(path).selectExpr("from_json(value, 'map<string,variant>') as r").where("r is not null")
    return spark.read.text(path, wholetext=True).selectExpr(
        "explode(from_json(value, 'array<map<string,variant>>')) as r"
    )


def _key(*names: str) -> str:
    """SQL: the value of the first key that the record has."""
    *others, last = names
    return "".join(f"if(map_contains_key(r, '{n}'), r['{n}'], " for n in others) + f"r['{last}']" + ")" * len(others)


def read_samples(spark: SparkSession, path: str, style: str = "list", lines: bool = False,
                 splittable: bool = False) -> DataFrame:
    """Schema-tolerant sample reader: (Year, Day, DataSource, code, labels).

    Code is ``Data`` or ``code``; labels are ``Labels`` or ``labels``; records without code are dropped.
    ``style='list'`` takes a label string as one label, marks rows without usable labels 'Unknown' and
    drops records without a label key.  ``style='text'`` parses a label string (a JSON list, or comma
    separated), leaves rows without a label key with an empty list and drops a null in its place.
    """
    raw = read_records(spark, path, lines, splittable).selectExpr(
        f"try_variant_get({_key('Year', 'year')}, '$', 'int') as Year",
        f"try_variant_get({_key('Day', 'day')}, '$', 'int') as Day",
        f"try_variant_get({_key('DataSource', 'source')}, '$', 'string') as DataSource",
        f"try_variant_get({_key('Data', 'code')}, '$', 'string') as code",
        f"{_key('Labels', 'labels')} as _labels",
    ).where(is_nonblank(F.col("code")))
    raw = raw.selectExpr(
        "*", "schema_of_variant(_labels) as _kind", "try_variant_get(_labels, '$', 'string') as _text",
        "try_variant_get(_labels, '$', 'array<string>') as _list",
    )
    kind, text = F.col("_kind"), F.col("_text")
    if style == "text":
        labels = F.when(kind == "STRING", parse_label_text(text)).otherwise(
            F.filter(F.coalesce("_list", F.array().cast("array<string>")), is_nonblank))
        rows = raw.where(kind.isNull() | (kind != "VOID"))
    else:
        labels = F.when(kind == "STRING", F.array(text)).otherwise(clean_labels(F.col("_list")))
        rows = raw.where(kind.isNotNull())
    return rows.select("Year", "Day", "DataSource", "code", labels.alias("labels"))


def load_splits(spark: SparkSession, path: str, strict: bool = True, fmt: str = "parquet", suffix: str = "") -> DataFrame:
    """All splits of a written data set, with the ``split`` partition column.

    ``fmt`` is what it was written as ('parquet' or 'json'); ``suffix`` names a variant written beside it, as in
    ``samples_ngrams``.  A filter on ``split`` or ``DataSource`` prunes directories.  ``strict`` raises when one of the
    three splits has no row: three look-ups of one row, each in its own directory.
    """
    df = spark.read.format(fmt).load(path.rstrip("/") + suffix)
    if strict:
        missing = [s for s in SPLITS if df.where(F.col("split") == s).isEmpty()]
        if missing:
            raise FileNotFoundError(f"splits missing under {path}{suffix}: {missing}")
    return df
