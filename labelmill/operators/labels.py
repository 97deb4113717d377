"""Label matrix, label joins, label vocabularies and multi-hot forms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import let, string_array
from labelmill.functions.text import strip_space
from labelmill.session import values
from labelmill.vocab import LABEL_NAMES


def marked_columns(columns: Sequence[str], mark="X") -> Column:
    """Ordered names of the columns that carry the mark.  Row-local: no unpivot, no shuffle."""
    named = F.array(*[F.when(F.col(f"`{c}`") == F.lit(mark), F.lit(c)) for c in columns])
    return F.filter(named, lambda x: x.isNotNull())


def matrix_to_labels(wide: DataFrame, keys: Sequence[str], marks: Sequence[str], mark="X") -> DataFrame:
    """(keys..., Labels) from the wide matrix."""
    return wide.select(*keys, marked_columns(marks, mark).alias("Labels"))


def first_row_per_key(labels: DataFrame, keys: Sequence[str], order: str, value: str = "Labels") -> DataFrame:
    """The first label row of each key, as a min over (order, value): partial aggregation merges
    duplicates before the shuffle, so a key with many copies costs one row per task."""
    best = F.min_by(F.col(value), F.col(order)).alias(value)
    return labels.groupBy(*keys).agg(best)


def attach_labels(samples: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look up each sample's labels; an unknown key gives an empty list.

    ``labels`` has one row per key.  Samples are the streamed side of a left join: Spark
    broadcasts the label side when its measured size is under the broadcast threshold, and
    otherwise splits hot sample keys in the sort-merge join (adaptive skew join).
    """
    empty = F.array().cast("array<string>")
    joined = samples.join(labels.select(*keys, "Labels"), list(keys), "left")
    return joined.withColumn("Labels", F.coalesce("Labels", empty))


def label_join(labels: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Label rows LEFT JOIN samples: keys without samples stay with null sample columns, samples
    whose key has no label row are dropped.

    Written as (samples JOIN labels) UNION ALL (labels without samples).  A plain left join would
    have to hash the big side by a handful of keys and could not split a hot key, because only
    the preserved side of an outer join may be split.  In the inner join Spark either broadcasts
    the label side after measuring it or splits the hot sample keys, and the second branch only
    needs the distinct keys of the samples, which shrink before they are shuffled.
    """
    keys = list(keys)
    label_cols = [c for c in labels.columns if c not in keys]
    sample_cols = [c for c in samples.columns if c not in keys]
    matched = samples.join(labels, keys, "inner").select(*keys, *label_cols, *sample_cols)
    present = samples.select(*keys).distinct()
    nulls = [F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in sample_cols]
    alone = labels.join(present, keys, "left_anti").select(*keys, *label_cols, *nulls)
    return matched.unionByName(alone)


def union_sources(tagged: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Concatenate tables, each tagged with its literal source; columns are matched by name."""
    out = None
    for source, df in tagged:
        part = df.withColumn("DataSource", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def normalise_label(label: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    """Code to long name; a long name stays; anything else is lower-cased with space and '-' as '_'."""
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    trimmed = strip_space(label)
    loose = F.translate(F.lower(trimmed), " -", "__")
    return F.coalesce(F.try_element_at(mapping, trimmed), loose)


def normalise_labels(labels: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    """``normalise_label`` over a list; blank labels are dropped, unknown ones are kept."""
    return F.filter(F.transform(labels, lambda x: normalise_label(x, names)), lambda x: x != "")


def label_vocabulary(df: DataFrame, labels: str, known: Iterable[str] = ()) -> DataFrame:
    """Distinct union of the known labels and those found, one sorted column ``label``."""
    found = df.select(F.explode(labels).alias("label"))
    extra = values(df.sparkSession, known, "label")
    return found.union(extra).where(F.col("label").isNotNull()).distinct().orderBy("label")


def multi_hot(labels: Column, classes: Sequence[str]) -> list[Column]:
    """One 0/1 int column per class; labels outside the classes are ignored."""
    return [F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int").alias(c) for c in classes]


def multi_hot_long(df: DataFrame, labels: str, classes: Sequence[str], *keep: str) -> DataFrame:
    """Long form (keep..., label, y) with one row per class."""
    return df.select(*keep, labels, F.explode(string_array(classes)).alias("label")).select(
        *keep, "label", F.coalesce(F.array_contains(F.col(labels), F.col("label")), F.lit(False)).cast("int").alias("y")
    )


def label_string(classes: Sequence[str], none: str = "No Label") -> Column:
    """Inverse of ``multi_hot``: class names of the 1-columns joined with ', '."""
    return let(
        marked_columns(classes, 1),
        lambda on: F.when(F.size(on) == 0, F.lit(none)).otherwise(F.concat_ws(", ", on)),
    )
