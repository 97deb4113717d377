"""Bag-of-words, TF-IDF and feature blocks as long tables (doc, term, value).

An uncapped vocabulary is a table that is joined without a hint: it is shuffled when it is large, and a hot term is then split
by the adaptive skew join.  A vocabulary of at most ``BROADCAST_TERMS`` terms is marked for broadcast: Spark's estimate knows neither
the cap nor how many terms a row explodes into, and would rather send all counts of a narrow table through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.arrays import term_counts
from labelmill.session import materialise

BROADCAST_TERMS = 100_000  # a vocabulary with no larger cap is broadcast


def count_terms(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, term, cnt); counted inside each document row, so nothing is shuffled."""
    return docs.select(doc, F.explode(term_counts(tokens)).alias("_t")).select(doc, "_t.term", "_t.cnt")


def fit_vocabulary(counts: DataFrame) -> DataFrame:
    """Distinct terms of the training counts with document frequency and total count.
    A term present in every document reaches the shuffle once per task."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("cnt").alias("total"))


def apply_vocabulary(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keep the terms of the vocabulary; unseen terms are ignored."""
    return counts.join(vocabulary.select("term"), "term", "left_semi").select(*counts.columns)


def top_terms(counts: DataFrame, max_features: int | None, min_df: int) -> DataFrame:
    """(term, df, total): terms in at least ``min_df`` documents, then the ``max_features`` most frequent by total
    count, ties by term; None keeps all.

    How many terms have each total gives the total at rank ``max_features``: terms above it stay by a filter, and only
    the terms that have just that total are ordered.  No task sorts the vocabulary, and its rows are stored, so that the
    documents are counted once for all three uses.
    """
    terms = fit_vocabulary(counts).where(F.col("df") >= min_df)
    if max_features is None:
        return terms
    terms = materialise(terms)
    held = terms.groupBy("total").agg(F.count("*").alias("n"))  # a row per different total
    above = F.sum("n").over(Window.orderBy(F.desc("total"))) - F.col("n")
    cut = held.select("total", above.alias("above")).where(F.col("above") < max_features).agg(
        F.min(F.struct("total", "above")).alias("cut"))
    edge = cut.select(F.col("cut.total").alias("_total"), (max_features - F.col("cut.above")).alias("_room"))
    least, room = edge.select("_total").scalar(), edge.select("_room").scalar()
    ties = Window.partitionBy("total").orderBy("term")
    last = terms.where(F.col("total") == least).withColumn("_r", F.row_number().over(ties)).where(
        F.col("_r") <= room).drop("_r")
    return terms.where(F.col("total") > least).unionByName(last)


def fit_tfidf(counts: DataFrame, n_docs: Column, max_features: int | None, min_df: int) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    terms = top_terms(counts, max_features, min_df)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    return terms.select("term", idf.alias("idf"))


def transform_tfidf(counts: DataFrame, idf: DataFrame, doc: str) -> DataFrame:
    """(doc, term, weight): tf * idf, each document scaled to unit L2 norm.

    Only the per-document norm needs the rows of a document together: one shuffle by document, each
    group at most as many rows as the vocabulary has terms.
    """
    raw = counts.join(idf, "term").select(doc, "term", (F.col("cnt") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("_w") / norm).alias("weight"))


def tfidf(docs: DataFrame, doc: str, tokens: Column, max_features: int | None, min_df: int,
          n_docs: Column | None = None) -> DataFrame:
    """Fit and transform on the same documents; documents without tokens count in n.  Texts are not shuffled, only
    the (document, term, weight) rows of the vocabulary are, for the norm.  ``n_docs`` is for documents whose number is known more
    cheaply than by making them."""
    n_docs = docs.agg(F.count("*")).scalar() if n_docs is None else n_docs
    idf = fit_tfidf(count_terms(docs, doc, tokens), n_docs, max_features, min_df)
    if max_features is not None and max_features <= BROADCAST_TERMS:
        idf = F.broadcast(idf)
    return transform_tfidf(count_terms(docs, doc, tokens), idf, doc)


def feature_union(blocks: dict[str, DataFrame], doc: str, value: str = "value") -> DataFrame:
    """Feature blocks side by side: one long table whose terms carry their block."""
    parts = [
        df.select(doc, F.lit(block).alias("block"), "term", F.col(df.columns[-1]).cast("double").alias(value))
        for block, df in blocks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def term_variance(values: DataFrame, n_rows: Column, value: str = "value") -> DataFrame:
    """(term, variance) over all rows, absent entries counting as zero: E[x^2] - E[x]^2."""
    x = F.col(value).cast("double")
    sums = values.groupBy("term").agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    mean = F.col("_s") / n_rows
    return sums.select("term", (F.col("_q") / n_rows - mean * mean).alias("variance"))


def variance_filter(values: DataFrame, n_rows: Column, value: str = "value", min_columns: int = 0,
                    threshold: float = 0.001 * 0.999) -> DataFrame:
    """(term, variance, kept).  Keeps every column when none would remain; ``min_columns`` opts in to keeping every column
    of tables that have no more than that."""
    stats = term_variance(values, n_rows, value)
    passes = F.col("variance") > threshold
    totals = stats.agg(F.count("*").alias("columns"), F.count_if(passes).alias("passing"))
    active = totals.select((F.col("columns") > min_columns) & (F.col("passing") > 0)).scalar()
    return stats.withColumn("kept", ~active | passes)


def feature_shape(values: DataFrame, n_rows: Column, min_columns: int = 0) -> DataFrame:
    """(n_rows, n_columns, n_selected)."""
    return variance_filter(values, n_rows, min_columns=min_columns).agg(
        F.count("*").alias("n_columns"), F.count_if("kept").alias("n_selected")
    ).select(n_rows.alias("n_rows"), "n_columns", "n_selected")
