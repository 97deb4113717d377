"""The most frequent n-grams of each group, counted exactly without a row per different n-gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.text import ngram_buckets, ngram_strings, ngrams_in_buckets
from labelmill.session import materialise

BUCKETS = 1 << 16    # per group; what a task holds does not grow with the number of different n-grams
PROBES = 4           # fullest buckets counted first, per n-gram asked for
LISTED = 10_000      # buckets that a filter may list; beyond it every n-gram is counted


def _counts(df: DataFrame, group: str, grams: Column) -> DataFrame:
    return df.select(group, F.explode(grams).alias("gram")).groupBy(group, "gram").agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame, group: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_ngrams(df: DataFrame, group: str, tokens: Column, k: int, n: int = 3, buckets: int = BUCKETS,
               listed: int = LISTED) -> DataFrame:
    """(group, gram, n, rank): the ``k`` most frequent n-grams of each group, ties by the n-gram.

    A first pass counts n-grams by hash bucket, an upper bound for each n-gram in it.  The n-grams of the fullest buckets are
    counted exactly; the k-th of them bounds what the answer needs, so buckets below it hold none of it.  Buckets at or above it
    that were not among them are counted as well.  Where too many buckets reach the bound (a small or a flat table), all n-grams are
    counted.  The rows are the same in each case.
    """
    every = _ranked(_counts(df, group, ngram_strings(tokens, n)), group, k)
    loads = materialise(df.select(group, F.explode(ngram_buckets(tokens, F.col(group), buckets, n)).alias("bucket")).groupBy(
        group, "bucket").agg(F.count("*").alias("n")))
    fullest = Window.partitionBy(group).orderBy(F.desc("n"), "bucket")
    first = loads.withColumn("_r", F.row_number().over(fullest)).where(F.col("_r") <= PROBES * k)
    wanted = {r["bucket"] for r in first.select("bucket").distinct().limit(listed + 1).collect()}
    if not wanted or len(wanted) > listed:
        return every

    def exact(some: set[int]) -> DataFrame:
        return materialise(_counts(df, group, ngrams_in_buckets(tokens, F.col(group), buckets, sorted(some), n)))

    counts = exact(wanted)
    least = _ranked(counts, group, k).groupBy(F.col(group).alias("_g")).agg(
        F.max(F.when(F.col("rank") == k, F.col("n"))).alias("_least"))
    bound = F.coalesce(F.col("_least"), F.lit(0))
    heavy = loads.join(least, F.col(group).eqNullSafe(F.col("_g")), "left").where(F.col("n") >= bound)
    missed = {r["bucket"] for r in heavy.where(~F.col("bucket").isin(sorted(wanted))).select("bucket").distinct().limit(
        listed + 1).collect()}
    if len(wanted | missed) > listed:
        return every
    return _ranked(exact(wanted | missed) if missed else counts, group, k)
