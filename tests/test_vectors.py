"""Bag of words, TF-IDF, variance filter, embeddings, statistics."""

import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions.text import code_tokens, space_tokens
from labelmill.operators import embeddings as emb
from labelmill.operators import stats
from labelmill.operators import vectors as vec

DOCS = ["a b b c", "b c c d", "a a a", "", "z", "b c z z z"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, text string").repartition(3)


def test_tfidf(docs):
    got = {(r["id"], r["term"]): r["weight"] for r in vec.tfidf(docs, "id", space_tokens(F.col("text")), 3, 2).collect()}
    counts = [Counter(t.split()) for t in DOCS]
    df = Counter(t for c in counts for t in c)
    total = sum(counts, Counter())
    kept = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:3]
    for i, c in enumerate(counts):
        w = {t: c[t] * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1) for t in kept if t in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            assert got.pop((i, t)) == pytest.approx(x / norm)
    assert not got


def test_vocabulary_ignores_unseen_terms(docs):
    counts = vec.count_terms(docs, "id", space_tokens(F.col("text")))
    vocab = vec.fit_vocabulary(counts.where("id < 2"))
    kept = vec.apply_vocabulary(counts.where("id >= 2"), vocab)
    assert sorted(map(tuple, kept.collect())) == [(2, "a", 3), (5, "b", 1), (5, "c", 1)]
    assert {r["term"]: (r["df"], r["total"]) for r in vocab.collect()} == {"a": (1, 1), "b": (2, 3), "c": (2, 3), "d": (1, 1)}


def test_null_text_counts_as_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "None")], "id int, text string")
    assert sorted(map(tuple, vec.count_terms(df, "id", code_tokens(F.col("text"))).collect())) == [(2, "None", 1)]


def test_variance_filter(docs):
    values = vec.count_terms(docs, "id", space_tokens(F.col("text"))).withColumnRenamed("cnt", "value")
    n = docs.agg(F.count("*")).scalar()
    rows = {r["term"]: r for r in vec.variance_filter(values, n, min_columns=2, threshold=0.2).collect()}
    for t in "abcdz":
        assert rows[t]["variance"] == pytest.approx(statistics.pvariance([Counter(x.split())[t] for x in DOCS]))
        assert rows[t]["kept"] == (rows[t]["variance"] > 0.2)
    assert all(r["kept"] for r in vec.variance_filter(values, n, min_columns=5, threshold=0.2).collect())
    assert all(r["kept"] for r in vec.variance_filter(values, n, min_columns=2, threshold=99).collect())
    shape = vec.feature_shape(values, n, min_columns=15_000).head()
    assert tuple(shape) == (6, 5, 5)


def test_feature_union_keeps_blocks_apart(docs):
    counts = vec.count_terms(docs, "id", space_tokens(F.col("text")))
    both = vec.feature_union({"one": counts, "two": counts}, "id")
    assert both.count() == 2 * counts.count()
    assert {r["block"] for r in both.select("block").distinct().collect()} == {"one", "two"}


def test_supcon_loss(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(70):
        v = rng.normal(size=6)
        labels = [str(i % 5)] + (["even"] if i % 2 == 0 else []) if i != 3 else []
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], labels))
    df = spark.createDataFrame(rows, "id long, v array<float>, l array<string>").repartition(4)
    got = {r["batch"]: (r["n"], r["loss"]) for r in emb.supcon_loss(df, "id", "v", "l").collect()}
    for b in range(3):
        part = rows[b * 32:(b + 1) * 32]
        losses = []
        for i, (_, vi, li) in enumerate(part):
            z = [float(np.dot(np.float32(vi).astype(float), np.float32(vj).astype(float))) / 0.07 for _, vj, _ in part]
            top = max(z)
            lse = math.log(sum(math.exp(x - top) for j, x in enumerate(z) if j != i) + 1e-12)
            pos = [z[j] - top - lse for j, (_, _, lj) in enumerate(part) if j != i and set(li) & set(lj)]
            losses.append(sum(pos) / (len(pos) + 1e-12))
        assert got[b][0] == len(part) and got[b][1] == pytest.approx(-sum(losses) / len(part), abs=1e-6)
    mean = emb.mean_batch_loss(emb.supcon_loss(df, "id", "v", "l")).head()
    assert mean["loss"] == pytest.approx(sum(x for _, x in got.values()) / 3)
    assert emb.mean_batch_loss(emb.supcon_loss(df.where("id < 0"), "id", "v", "l")).head()["loss"] == 0.0


def test_supcon_batches_are_by_place_not_by_id(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))], [str(i % 3)]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, v array<float>, l array<string>").repartition(4)
    sparse = df.withColumn("id", F.col("id") * 1_000_003)
    want = [tuple(r) for r in emb.supcon_loss(df, "id", "v", "l").orderBy("batch").collect()]
    assert [tuple(r) for r in emb.supcon_loss(sparse, "id", "v", "l").orderBy("batch").collect()] == want
    same = emb.supcon_loss(df.withColumn("id", F.lit(5).cast("long")), "id", "v", "l").orderBy("batch").collect()
    assert [r["n"] for r in same] == [32, 32, 6]


def test_embed_reads_whole_texts_in_order(spark):
    def load():
        def encode(texts):
            windows = [emb.token_windows(t.split(), 4) for t in texts]
            return np.array([[sum(map(len, w)), len(w)] for w in windows], dtype=float)
        return encode

    df = spark.createDataFrame([(0, "a " * 9), (1, None), (2, "x y")], "i int, t string")
    got = [(r["i"], list(r["e"])) for r in df.select("i", emb.embed(F.col("t"), load, 2).alias("e")).orderBy("i").collect()]
    assert got == [(0, [9.0, 3.0]), (1, [0.0, 1.0]), (2, [2.0, 1.0])]


def test_mean_pool_of_fully_masked_group(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("b", [5.0, 5.0], 0)], "g string, v array<float>, m int")
    got = {(r["g"], r["dim"]): r["value"] for r in emb.mean_pool(df, "g", "v", F.col("m")).collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 4.0, ("b", 0): 0.0, ("b", 1): 0.0}


def test_statistics(spark):
    lengths = [3, 3, 8, 1, 10, 4]
    df = spark.createDataFrame([("x" * n, ["p"] * (n % 3)) for n in lengths], "t string, l array<string>")
    r = stats.length_stats(df, F.length("t")).head()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (statistics.mean(lengths), statistics.median(lengths), 1, 10)
    assert r["std"] == pytest.approx(statistics.pstdev(lengths))
    assert tuple(stats.dataset_totals(df, "l").head()) == (6, sum(n % 3 for n in lengths), 1)
    assert tuple(stats.dataset_totals(df.where("t = ''"), "l").head()) == (0, 0, 0)
    assert stats.unknown_labels(df, "l", ["p"]).count() == 0 and stats.unknown_labels(df, "l", []).count() == 1
