"""The contrastive encoder against one process, numeric derivatives and held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import contrastive as co
from labelmill.operators.embeddings import _batch_loss

BUCKETS, WIDTH = 256, 8


@pytest.fixture(scope="module")
def rows(spark):
    """Two topics of their own words among shared ones; odd cases at the end."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(400):
        topic = i % 2
        words = [f"t{topic}w{k}" for k in rng.integers(0, 15, 4)] + [f"c{k}" for k in rng.integers(0, 40, 8)]
        out.append((i, " ".join(rng.permutation(words)), [f"topic{topic}"] + (["extra"] if i % 7 == 0 else [])))
    out += [(400, None, ["topic0"]), (401, "", []), (402, "t0w1 c1", None), (403, "t0w1 c1", ["topic0", "topic0"])]
    return spark.createDataFrame(out, "id int, text string, labels array<string>").repartition(3)


def blocks(rows, tasks=3):
    return co.pack(rows, "text", "labels", BUCKETS, tasks, 2)


def start():
    return np.random.default_rng(1).standard_normal((BUCKETS, WIDTH))


def test_loss_is_the_loss_operator_s(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((32, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = [rng.choice(9, rng.integers(0, 3), replace=False) for _ in range(32)]
    got, _ = co.loss_and_slope(v, [np.asarray(x, np.int64) for x in labels], 0.07)
    assert got == pytest.approx(_batch_loss(v, [list(map(str, x)) for x in labels], 0.07))


def test_gradient_is_the_numeric_one():
    rng = np.random.default_rng(7)
    rows = [(np.sort(rng.choice(BUCKETS, 5, replace=False)).astype(np.int32), np.full(5, 0.2, np.float32)) for _ in range(9)]
    rows.append((np.empty(0, np.int32), np.empty(0, np.float32)))
    labels = [np.array([i % 3], np.int64) for i in range(9)] + [np.empty(0, np.int64)]
    weights, slope = start(), np.zeros((BUCKETS, WIDTH))
    co.batch_gradient(rows, labels, weights, 0.5, slope)
    for slot in rows[0][0][:3]:
        for d in range(3):
            high, low = weights.copy(), weights.copy()
            high[slot, d] += 1e-5
            low[slot, d] -= 1e-5
            numeric = (co.batch_gradient(rows, labels, high, 0.5) - co.batch_gradient(rows, labels, low, 0.5)) / 2e-5
            assert slope[slot, d] == pytest.approx(numeric, abs=1e-7)


def test_distributed_gradient_is_one_process_s(spark, rows, tmp_path):
    blocks(rows).write.parquet(str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    n, loss, slope = co.evaluate(stored.repartition(5), start())
    total, losses = np.zeros((BUCKETS, WIDTH)), []
    for block in stored.toPandas().itertuples(index=False):
        for batch, labels in co.batches_of(block):
            losses.append(co.batch_gradient(batch, labels, start(), co.TEMPERATURE, total))
    assert n == len(losses) and loss == pytest.approx(np.mean(losses))
    np.testing.assert_allclose(slope, total / n, atol=1e-12)


def test_every_row_is_in_one_batch(rows):
    for tasks in (1, 4):
        got = [len(b) for x in blocks(rows, tasks).toPandas().itertuples(index=False) for b, _ in co.batches_of(x)]
        assert sum(got) == 404 and sum(n < 32 for n in got) <= tasks


def test_held_out_loss_falls_and_texts_of_a_topic_meet(spark, rows):
    train, val = rows.where("id % 5 != 0"), rows.where("id % 5 = 0")
    encoder = co.fit_encoder(train, val, "text", "labels", BUCKETS, WIDTH, epochs=6, steps=2, rate=0.1)
    assert min(encoder.losses) < encoder.losses[0] - 0.5
    assert encoder.losses[encoder.best_epoch] == min(encoder.losses)
    got = co.embed_with_encoder(val.where("id < 400"), "text", encoder).toPandas()
    v, topic = np.array(got["embedding"].tolist()), got["id"].to_numpy() % 2
    near = v @ v.T - 2 * np.eye(len(v))
    assert (topic[near.argmax(axis=1)] == topic).mean() > 0.95
    empty = co.embed_with_encoder(rows.where("id in (400, 401)"), "text", encoder).collect()
    assert [set(r["embedding"]) for r in empty] == [{0.0}] * 2


def test_goes_on_after_an_interruption(spark, rows, tmp_path):
    fit = lambda epochs, folder: co.fit_encoder(
        rows.coalesce(1), None, "text", "labels", BUCKETS, WIDTH, epochs=epochs, steps=1, warmup=0.0, patience=9, folder=folder)
    whole = fit(3, str(tmp_path / "a"))
    fit(1, str(tmp_path / "b"))
    again = fit(3, str(tmp_path / "b"))
    assert len(again.losses) == 4
    np.testing.assert_allclose(again.losses, whole.losses, rtol=1e-6)


def test_empty_table_and_bound(spark, rows):
    none = rows.where(F.lit(False))
    encoder = co.fit_encoder(none, none, "text", "labels", BUCKETS, WIDTH, epochs=2, steps=1)
    assert encoder.weights.shape == (BUCKETS, WIDTH) and encoder.best_epoch == 0
    with pytest.raises(ValueError):
        co.fit_encoder(none, None, "text", "labels", 1 << 20, 64)


def test_registered_query_finds_languages(spark, sf):
    """Mean vectors of the training documents name most test documents' languages; no test text was learned from."""
    from labelmill.plans import registry
    got = {r["doc_id"]: r["lang"] for r in registry.queries()["contrastive_centroids"](spark, sf).collect()}
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert got and sum(want[k] == v for k, v in got.items()) >= 0.8 * len(got)


def test_registered_vectors_are_unit_vectors(spark, sf):
    from labelmill.plans import registry
    df = registry.queries()["contrastive_embeddings"](spark, sf)
    norms = df.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"), F.count("*").alias("w")).collect()
    assert len(norms) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["w"] == co.WIDTH and (abs(r["n"] - 1.0) < 1e-5 or r["n"] == 0.0) for r in norms)
