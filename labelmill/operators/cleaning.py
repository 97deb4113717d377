"""Row filters and reductions of the cleaning step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.pycode import strip_comments
from labelmill.functions.text import is_nonblank, strip_imports
from labelmill.sources.nested_json import in_calendar


def keep_nonblank(df: DataFrame, code: str) -> DataFrame:
    return df.where(is_nonblank(F.col(code)))


def clean_code(code: Column) -> Column:
    """Imports out on the JVM, then comments and docstrings in an Arrow batch; null when it cannot be read."""
    return strip_comments(strip_imports(code))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key.  ``max`` over a struct combines map-side, so a hot key sends one
    row per task instead of all its rows to one window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    out = df.groupBy(*keys).agg(best.alias("_last"))
    return out.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def project_records(df: DataFrame, *extra: str) -> DataFrame:
    """The five record columns (and ``extra``) of the samples in the configured calendar that have code."""
    cols = df.select("Year", "Day", "DataSource", "Data", "Labels", *extra)
    return keep_nonblank(cols.where(in_calendar(F.col("Year"), F.col("Day"))), "Data")
