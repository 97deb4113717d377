"""The plans are the ones meant for large data, and results do not depend on the layout."""

import pytest
from pyspark.sql import functions as F

from labelmill.functions.text import code_tokens
from labelmill.operators import labels as lb
from labelmill.operators import vectors as vec
from labelmill.plans import registry
from labelmill.session import spread
from tests.harness import canonical

QUERIES = registry.queries()
TRAINED = {n for n in QUERIES if n.endswith("_metrics")} | {"grid_search_scores", "embed_documents", "embedding_projection",
                                                                "contrastive_embeddings", "contrastive_centroids"}
PYTHON = {"page_links", "distinct_links", "page_blocks", "page_block_filter", "page_text", "page_text_blocks", "syntax_valid", "repair_code", "strip_comments", "clean_code",
          "ast_nodes", "tree_structural_counts", "tree_path_contexts", "tree_context_text", "tfidf_paths", "tfidf_node_types", "embed_texts", "supcon_loss", "mean_batch_loss"}
NARROW = ["hash_split", "code_tokens", "tfidf_tokens", "tf_l2_per_doc", "strip_imports", "snippet_preview",
          "label_matrix_to_array", "page_links", "rank_line_filter", "ast_nodes", "tree_structural_counts", "tree_path_contexts",
          "l2_normalize", "feature_union", "threshold_labels", "nested_json_explode", "page_blocks"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_product_joins_and_no_stray_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = any(k in text for k in ("ArrowEvalPython", "MapInPandas", "MapInArrow", "BatchEvalPython"))
    assert python == (name in PYTHON)
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", NARROW)
def test_row_local_work_shuffles_nothing(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Exchange" not in text


def test_scans_are_dealt_out_on_request_only(spark):
    df = spark.range(1000, numPartitions=3)
    assert spread(df) is df
    spark.conf.set("labelmill.scanTasks", "5")
    try:
        assert spread(df).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("labelmill.scanTasks")


def test_scans_read_only_what_they_need(spark, sf):
    assert "ReadSchema: struct<doc_id:bigint>" in plan(QUERIES["hash_split"](spark, sf))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(QUERIES["url_harvest"](spark, sf))
    assert "PushedFilters: [IsNotNull(url), StringContains(url,example.org)]" in plan(QUERIES["url_harvest"](spark, sf))


def test_top_k_per_group_is_cut_before_the_shuffle(spark, sf):
    assert plan(QUERIES["token_ngrams"](spark, sf)).count("WindowGroupLimit") >= 2


def test_text_is_not_shuffled_by_the_evaluation(spark, sf):
    text = plan(QUERIES["eval_by_source"](spark, sf))
    assert "partial_sum" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(QUERIES["eval_by_source"](spark, sf))
        side = joined[joined.index("SortMergeJoin"):]
        exchange = side[side.index("Exchange"):]
        assert "Project [doc_id" in exchange.split("\n")[1] and "text#" not in exchange.split("\n")[1].split("Contains")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_join_is_split(spark):
    """A third of all samples share one key: the sort-merge join splits that key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    labels = spark.range(60).select(F.col("id").alias("k"), F.array(F.lit("x")).alias("Labels"))
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 60)
    samples = spark.range(60_000, numPartitions=8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("Data"))
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        for df in (lb.attach_labels(samples, labels, ["k"]), lb.label_join(labels, samples, ["k"])):
            assert df.where("Data is not null").count() == 60_000
            df.collect()
            assert "skew=true" in plan(df)
    finally:
        for c in settings:
            spark.conf.unset(c)


LAYOUT = ["eval_by_source", "eval_report", "label_left_join", "last_per_user", "exact_split", "token_ngrams", "bow_counts",
          "variance_filter", "best_path_per_key", "strict_path_per_key", "distinct_links", "label_distribution", "tfidf_vocabulary"]


@pytest.mark.parametrize("name", LAYOUT)
def test_results_do_not_depend_on_the_number_of_partitions(spark, sf, name):
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, sf)
        got.append(canonical(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


def test_uncapped_vocabulary_is_not_forced_to_broadcast(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = vec.count_terms(docs, "doc_id", code_tokens(F.col("text")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(vec.apply_vocabulary(counts, vec.fit_vocabulary(counts)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name, step", [("embed_documents", "regexp_extract_all("), ("embed_texts", "ArrowEvalPython "),
                                        ("contrastive_embeddings", "ArrowEvalPython ")])
def test_vectors_are_computed_once_a_document(spark, sf, name, step):
    assert plan(QUERIES[name](spark, sf)).count(step) == 1
