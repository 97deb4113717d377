"""Narrow tables of many rows: work on all cores, and nothing whole through the driver."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from labelmill import session as ss
from labelmill.functions.text import ngram_strings, space_tokens
from labelmill.operators import grams as gr
from labelmill.operators import logistic as lg
from labelmill.operators import models as md
from labelmill.operators import vectors as vec
from labelmill.plans import registry
from tests.test_plans import plan

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A part table of 60,000 rows in one file."""
    folder = str(tmp_path_factory.mktemp("wide"))
    rows = spark.range(60_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def test_a_crowded_scan_is_dealt_to_more_tasks(spark, wide):
    scan = ss.table(spark, wide, "part")
    dealt = ss.spread(scan)
    assert scan.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 6
    assert dealt.exceptAll(scan).isEmpty() and dealt.count() == 60_000


def test_a_scan_that_is_spread_already_is_not_shuffled(spark):
    df = spark.range(400_000, numPartitions=16)
    assert ss.spread(df) is df


@pytest.mark.parametrize("name", ["ast_nodes", "tree_structural_counts", "tree_path_contexts", "tree_context_text"])
def test_syntax_trees_are_made_by_more_than_one_task(spark, wide, name):
    assert QUERIES[name](spark, wide).rdd.getNumPartitions() == 6


@pytest.mark.parametrize("name", ["tfidf_paths", "tfidf_node_types"])
def test_the_vocabulary_is_broadcast_and_not_the_counts(spark, wide, name):
    text = plan(QUERIES[name](spark, wide))
    assert "Inner, BuildRight" in text and "Inner, BuildLeft" not in text


def test_documents_without_terms_count_when_their_number_is_given(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "b c"), (4, None), (5, "")], "id int, text string")
    tokens = space_tokens(F.col("text"))
    assert sorted(vec.tfidf(docs, "id", tokens, 3, 2).collect()) == sorted(vec.tfidf(docs, "id", tokens, 3, 2, F.lit(5)).collect())


def test_forests_keep_node_ids_and_grow_the_same_trees(spark):
    vector = F.udf(lambda i: Vectors.dense([float(i % 7), float(i * i % 11), float(i % 3)]), VectorUDT())
    rows = spark.range(400, numPartitions=3).select(vector("id").alias("features"), (F.col("id") % 5 < 2).cast("double").alias("_y"))
    build = md.forest(4, 6)(400, 160)
    assert build.getCacheNodeIds()
    plain = build.copy().setCacheNodeIds(False)
    assert build.fit(rows).toDebugString.split("\n")[1:] == plain.fit(rows).toDebugString.split("\n")[1:]


def test_a_logistic_pass_has_a_task_per_core_at_most(spark):
    cores = spark.sparkContext.defaultParallelism
    i = F.col("id").cast("int")
    rows = spark.range(500, numPartitions=5 * cores).select(
        F.array(i % 7, 7 + i % 5).alias("slots"), F.array(F.lit(1.0), i / 100.0).alias("values"),
        F.array(i % 2 == 0, i % 3 == 0).alias("labels"), F.lit(-2).alias("fold"))
    blocks = lg.pack(rows, 12)
    assert blocks.rdd.getNumPartitions() <= cores
    dense, truth = np.zeros((500, 13)), np.zeros((500, 2), bool)
    for n, r in enumerate(rows.collect()):
        dense[n, r["slots"]], dense[n, 12], truth[n] = r["values"], 1.0, r["labels"]
    used = lg.used_slots(blocks)
    points = np.random.default_rng(1).normal(size=(len(used), 3))
    label = np.array([0, 1, 1])
    loss, gradient = lg.evaluate(blocks, used, points, label, np.full(3, -1))
    margin, y = dense[:, used] @ points, truth[:, label]
    assert np.allclose(loss, np.logaddexp(0.0, np.where(y, -margin, margin)).sum(axis=0))
    assert np.allclose(gradient, dense[:, used].T @ (1 / (1 + np.exp(-margin)) - y))


def test_top_ngrams_hold_no_row_per_different_ngram(spark, tmp_path):
    """Heavy n-grams in a sea of rare ones: the counted buckets are few, and ties at the cut and null groups stay right."""
    common = F.when(F.col("id") % 2 == 0, F.lit("a b c d")).otherwise(F.lit("b c d"))
    texts = spark.range(3000, numPartitions=4).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("lang"),
        F.concat_ws(" ", common, F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    texts = texts.union(spark.createDataFrame([("few", "x y z"), ("few", None)], "lang string, text string"))
    tokens = space_tokens(F.col("text"))
    want = gr._ranked(gr._counts(texts, "lang", ngram_strings(tokens)), "lang", 2).collect()
    assert len(want) == 7
    for buckets, listed in ((gr.BUCKETS, gr.LISTED), (7, 2), (7, 100), (500, 40)):
        got = gr.top_ngrams(texts, "lang", tokens, 2, buckets=buckets, listed=listed)
        assert sorted(got.collect(), key=str) == sorted(want, key=str)
    assert "concat_ws" not in plan(gr.top_ngrams(texts, "lang", tokens, 2))


def test_a_capped_vocabulary_counts_the_documents_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "b c"), (4, None)], "id int, text string")
    fitted = vec.fit_tfidf(vec.count_terms(docs, "id", space_tokens(F.col("text"))), F.lit(4), 2, 2)
    assert "sort_array" not in plan(fitted)
    assert {r["term"] for r in fitted.collect()} == {"a", "b"}
