"""Every registered query against its SQL; the others against what must hold for any result."""

import pytest

import __spark_entry__ as entry
from labelmill.plans import registry
from tests.harness import compare

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
UNCHECKED = sorted(set(QUERIES) - set(ORACLES))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    same, note = compare(QUERIES[name](spark, sf), duck, ORACLES[name])
    assert same, note
    assert "types" not in note, note


METRIC_QUERIES = [n for n in UNCHECKED if n.endswith("_metrics")]


@pytest.mark.parametrize("name", METRIC_QUERIES)
def test_model_metrics_are_proportions(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == 11
    for r in rows:
        if r["metric"] != "sample_count":
            assert 0.0 <= r["value"] <= 1.0, r
    if name == "per_label_forest_metrics":  # the code forms can be told from the trees
        assert next(r["value"] for r in rows if r["metric"] == "f1_micro") > 0.8


def test_grid_scores(spark, sf):
    rows = QUERIES["grid_search_scores"](spark, sf).collect()
    assert len(rows) == 18 and {r["fold"] for r in rows} == {0, 1, 2}
    assert all(0.0 <= r["f1_macro"] <= 1.0 for r in rows)
    assert len({r["point"] for r in rows if r["best"]}) == 1


def test_document_embeddings_are_unit_vectors(spark, sf):
    from pyspark.sql import functions as F

    df = QUERIES["embed_documents"](spark, sf)
    norms = df.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"), F.count("*").alias("w"))
    for r in norms.collect():
        assert r["w"] == 128 and (abs(r["n"] - 1.0) < 1e-6 or r["n"] == 0.0)


def test_projection_has_one_row_per_vector(spark, sf, duck):
    rows = QUERIES["embedding_projection"](spark, sf).collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    assert all(len(r["snippet"]) == 83 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
