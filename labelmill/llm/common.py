"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labelmill.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, lineage cut there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``checkpoint`` and how many rows fulfil ``condition``, counted while they are written: no second job."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get.get("n") or 0


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: smaller than a checkpoint where they are read again
    and again.  Whoever owns the folder clears it.

    Its size estimate is that of its files.  A checkpoint keeps the estimate of the plan that made it, which a join
    multiplies: a table that is joined with itself round after round would get an estimate of millions of digits.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``stored`` and how many rows fulfil ``condition``, counted while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get.get("n") or 0


def held_out(key: Column, folds: int) -> Column:
    """True where crc32(key as text) mod ``folds`` is 0; a null key is held out, nothing is learned from it."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(True))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges(a, b)``: the smallest id that links lead to.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their roots by pointer
    doubling and contracts the links to links between roots, until none is left.  A star of any size is gone
    after two rounds and a chain of n vertices after log n doublings.  All steps are equi-joins and aggregates
    whose hot keys are combined before the shuffle or split by the adaptive skew join.  Null ends and loops
    are ignored; an empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    links, left = stored_counting(
        edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), a.isNotNull())
    found = None
    while found is None or left:
        both = links.select(a.alias("id"), b.alias("to")).union(links.select(b.alias("id"), a.alias("to")))
        hooks = stored(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")))
        moving = left
        while moving:
            onward = hooks.select(F.col("id").alias("to"), F.col("to").alias("_next"))
            hooks, moving = stored_counting(
                hooks.join(onward, "to").select("id", F.col("_next").alias("to"), (F.col("to") != F.col("_next")).alias("_moved")),
                F.col("_moved"))
            hooks = hooks.drop("_moved")
        if found is None:
            found = hooks.withColumnRenamed("to", "component")
        else:
            root = hooks.select(F.col("id").alias("component"), "to")
            found = stored(found.join(root, "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")))
        if left:
            ends = links
            for end in ("a", "b"):
                ends = ends.join(hooks.select(F.col("id").alias(end), F.col("to").alias(f"_{end}")), end)
            links, left = stored_counting(ends.where("_a != _b").select(
                F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), a.isNotNull())
    return found


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the given links connect, one less than the vertices at most."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out
