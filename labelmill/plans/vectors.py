"""Registered queries: bag of words, TF-IDF, feature blocks, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions.arrays import l2_normalize as unit
from labelmill.functions.arrays import masked_mean
from labelmill.functions.text import code_tokens
from labelmill.operators import contrastive as con
from labelmill.operators import embeddings as emb
from labelmill.operators import vectors as vec
from labelmill.operators.splits import hash_split
from labelmill.plans.inputs import documents, rounded
from labelmill.plans.syntax import tfidf_sql
from labelmill.plans.texts import CODE_SQL
from labelmill.session import materialise, spread, table


def bow_counts(spark, sf):
    """Counts of the test documents over the vocabulary of the training documents."""
    docs = documents(spark, sf, "doc_id", "text").withColumn("split", hash_split(F.col("doc_id")))
    counts = lambda split: vec.count_terms(
        docs.where(F.col("split") == split), "doc_id", code_tokens(F.col("text")))
    return vec.apply_vocabulary(counts("test"), vec.fit_vocabulary(counts("train")))


# The vocabulary that the queries ask for.
TFIDF_TERMS, TFIDF_MIN_DF = 7500, 2


def tfidf_topk(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return rounded(vec.tfidf(docs, "doc_id", code_tokens(F.col("text")), TFIDF_TERMS, TFIDF_MIN_DF), "weight")


def tfidf_vocabulary(spark, sf):
    """The capped vocabulary with its weights."""
    docs = documents(spark, sf, "doc_id", "text")
    counts = vec.count_terms(docs, "doc_id", code_tokens(F.col("text")))
    return rounded(vec.fit_tfidf(counts, docs.agg(F.count("*")).scalar(), 500, TFIDF_MIN_DF), "idf")


def _blocks(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "lang", "source")
    tags = docs.select("doc_id", F.explode(F.array("lang", "source")).alias("term"), F.lit(1).alias("cnt"))
    return {"bow": vec.count_terms(docs, "doc_id", code_tokens(F.col("text"))), "tag": tags}


def feature_union(spark, sf):
    return vec.feature_union(_blocks(spark, sf), "doc_id")


def _n_docs(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*")).scalar()


def variance_filter(spark, sf):
    values = vec.feature_union(_blocks(spark, sf), "doc_id").withColumn("term", F.concat_ws(":", "block", "term"))
    return rounded(vec.variance_filter(values, _n_docs(spark, sf), min_columns=1000), "variance")


def feature_shape(spark, sf):
    values = vec.feature_union(_blocks(spark, sf), "doc_id").withColumn("term", F.concat_ws(":", "block", "term"))
    return vec.feature_shape(values, _n_docs(spark, sf), min_columns=1000)


def _embeddings(spark, sf):
    return spread(table(spark, sf, "embeddings"))


def mean_pool(spark, sf):
    """Mean vector per label over the vectors whose first component is positive."""
    mask = (F.get("embedding", F.lit(0)) > 0).cast("int")
    return rounded(emb.mean_pool(_embeddings(spark, sf), "label", "embedding", mask), "value")


def masked_sequence_mean(spark, sf):
    """Every vector read as a sequence of 16 four-wide token vectors, every third token masked out."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i % 3 == 0, 0).otherwise(1))
    pooled = _embeddings(spark, sf).select("vec_id", F.posexplode(masked_mean(tokens, mask)).alias("dim", "value"))
    return rounded(pooled, "value")


def l2_normalize(spark, sf):
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3)
    out = _embeddings(spark, sf).select("vec_id", F.posexplode(unit(doubled)).alias("dim", "value"))
    return rounded(out, "value")


def _losses(spark, sf):
    labels = F.array(F.col("label").cast("string"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")))
    rows = _embeddings(spark, sf).select("vec_id", "embedding", labels.alias("labels"))
    return emb.supcon_loss(rows, "vec_id", "embedding", "labels")


def supcon_loss(spark, sf):
    return rounded(_losses(spark, sf), "loss")


def mean_batch_loss(spark, sf):
    return rounded(emb.mean_batch_loss(_losses(spark, sf)), "loss")


def embedding_projection(spark, sf):
    rows = _embeddings(spark, sf)
    text = F.concat_ws(",", F.transform("embedding", lambda x: F.round(x, 3).cast("string")))
    return rounded(emb.project_2d(rows, "embedding", F.col("label").cast("string"), text, "vec_id"), "x", "y")


CONTRASTIVE_EPOCHS, CONTRASTIVE_STEPS = 3, 4

VOWELS = "aeio"


def _vowel_encoder():
    """A stand-in encoder: how often each of four letters occurs, read window by window."""
    import numpy as np

    def encode(texts):
        windows = [emb.token_windows(t, emb.MAX_TOKENS) for t in texts]
        return np.array([[sum(w.count(v) for w in ws) for v in VOWELS] for ws in windows], dtype=float)

    return encode


def embed_texts(spark, sf):
    """A user-supplied encoder over whole texts, scaled to unit norm."""
    docs = documents(spark, sf, "doc_id", "text")
    vectors = docs.select("doc_id", emb.unit_embedding(F.col("text"), _vowel_encoder).alias("v"))
    return rounded(emb.components(vectors, "v", "doc_id"), "value")


def embed_documents(spark, sf):
    """Default encoder fitted on the training documents and applied to all."""
    docs = documents(spark, sf, "doc_id", "text")
    train = docs.where(hash_split(F.col("doc_id")) == "train")
    model = emb.fit_word_vectors(train, "text")
    out = emb.embed_with_words(docs, "text", model)
    return emb.components(out, "embedding", "doc_id", F.size("embedding").alias("width"))


def _contrastive(spark, sf):
    """All documents with the vectors of an encoder whose positives share their language, fitted on the training documents."""
    docs = documents(spark, sf, "doc_id", "text", "lang").withColumn("split", hash_split(F.col("doc_id")))
    labels = F.when(F.col("lang").isNotNull(), F.array("lang")).alias("labels")
    part = {s: docs.where(F.col("split") == s).select("text", labels) for s in ("train", "val")}
    encoder = con.fit_encoder(part["train"], part["val"], "text", "labels", epochs=CONTRASTIVE_EPOCHS, steps=CONTRASTIVE_STEPS)
    return con.embed_with_encoder(docs, "text", encoder)


def contrastive_embeddings(spark, sf):
    """Contrastively trained vectors of all documents."""
    return emb.components(_contrastive(spark, sf), "embedding", "doc_id")


def contrastive_centroids(spark, sf):
    """The language of every test document by the nearest mean vector of the training documents of a language."""
    docs = materialise(_contrastive(spark, sf).select("doc_id", "lang", "split", "embedding"))
    known = docs.where((F.col("split") == "train") & F.col("lang").isNotNull())
    cells = emb.mean_pool(known, "lang", "embedding", F.lit(1))
    means = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("cells")).select(
        "lang", unit(F.col("cells.value")).alias("mean"))
    listed = means.agg(F.sort_array(F.collect_list(F.struct("lang", "mean")))).scalar()
    near = F.transform("_means", lambda m: F.struct(
        F.aggregate(F.zip_with(m["mean"], "embedding", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y).alias("near"),
        m["lang"].alias("lang")))
    asked = docs.where((F.col("split") == "test") & F.col("lang").isNotNull())
    return asked.select("doc_id", "embedding", listed.alias("_means")).select("doc_id", F.array_max(near)["lang"].alias("lang"))


QUERIES = {
    f.__name__: f
    for f in (
        bow_counts, tfidf_topk, tfidf_vocabulary, feature_union, variance_filter, feature_shape, mean_pool,
        masked_sequence_mean, l2_normalize, supcon_loss, mean_batch_loss, embedding_projection, embed_texts,
        embed_documents, contrastive_embeddings, contrastive_centroids,
    )
}

TOKENS = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '{CODE_SQL}', 0)) AS term FROM documents),
n_docs AS (SELECT count(*) AS n FROM documents)"""
_UNION = f"""WITH {TOKENS},
u AS (
  SELECT doc_id, 'bow' AS block, term, count(*)::DOUBLE AS value FROM tok GROUP BY ALL
  UNION ALL SELECT doc_id, 'tag', lang, 1 FROM documents UNION ALL SELECT doc_id, 'tag', source, 1 FROM documents)"""
_VARIANCE = _UNION + """,
v AS (SELECT block || ':' || term AS term, sum(value * value) / max(n) - (sum(value) / max(n)) ** 2 AS variance
      FROM u, n_docs GROUP BY ALL),
k AS (SELECT *, NOT ((count(*) OVER () > 1000) AND (count(*) FILTER (variance > 0.001 * 0.999) OVER () > 0))
        OR variance > 0.001 * 0.999 AS kept FROM v)
"""
_LOSS = """
WITH e AS (SELECT vec_id, vec_id // 32 AS batch, embedding::DOUBLE[] AS v, label FROM embeddings),
p AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) / 0.07 AS z,
        (a.label = b.label OR a.label % 3 = b.label % 3) AS pos
      FROM e a JOIN e b ON a.batch = b.batch),
m AS (SELECT i, max(z) AS top FROM p GROUP BY i),
s AS (SELECT i, ln(sum(exp(z - top)) FILTER (i <> j) + 1e-12) AS lse FROM p JOIN m USING (i) GROUP BY i),
a AS (SELECT batch, i, coalesce(sum(z - top - lse) FILTER (pos AND i <> j), 0)
        / (count(*) FILTER (pos AND i <> j) + 1e-12) AS mean_pos
      FROM p JOIN m USING (i) JOIN s USING (i) GROUP BY batch, i),
b AS (SELECT batch, count(*) AS n, -avg(mean_pos) AS loss FROM a GROUP BY batch)
"""

ORACLES = {
    "bow_counts": f"""
WITH b AS (SELECT doc_id, text, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10000 AS bucket FROM documents),
tok AS (SELECT doc_id, bucket, unnest(regexp_extract_all(text, '{CODE_SQL}', 0)) AS term FROM b)
SELECT doc_id, term, count(*) AS cnt FROM tok
WHERE bucket < 1000 AND term IN (SELECT term FROM tok WHERE bucket >= 2000) GROUP BY ALL""",
    "tfidf_topk": "WITH " + TOKENS + tfidf_sql("tok", "doc_id"),
    "tfidf_vocabulary": "WITH " + TOKENS + """,
tf AS (SELECT doc_id, term, count(*) AS cnt FROM tok GROUP BY ALL),
stat AS (SELECT term, count(*) AS df, sum(cnt) AS total FROM tf GROUP BY term HAVING count(*) >= 2
         ORDER BY total DESC, term LIMIT 500)
SELECT term, round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1, 6) AS idf FROM stat, n_docs""",
    "feature_union": _UNION + "SELECT doc_id, block, term, value FROM u",
    "variance_filter": _VARIANCE + "SELECT term, round(variance, 6) AS variance, kept FROM k",
    "feature_shape": _VARIANCE + """
SELECT (SELECT n FROM n_docs) AS n_rows, count(*) AS n_columns, count(*) FILTER (kept) AS n_selected FROM k""",
    "mean_pool": """
WITH c AS (SELECT label, (embedding[1] > 0)::INT AS m, unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE AS x
           FROM embeddings)
SELECT label, dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS value FROM c GROUP BY ALL""",
    "masked_sequence_mean": """
WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, (k % 4)::INT AS dim, round(sum(x) FILTER ((k // 4) % 3 <> 0) / 10, 6) AS value FROM c
GROUP BY vec_id, k % 4""",
    "l2_normalize": """
WITH c AS (SELECT vec_id, unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE * 3 AS x FROM embeddings)
SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM c""",
    "embed_texts": """
WITH c AS (SELECT doc_id, unnest(range(0, 4))::INT AS dim,
             length(text) - length(replace(text, unnest(['a', 'e', 'i', 'o']), '')) AS x FROM documents)
SELECT doc_id, dim, round(coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0), 0), 6) AS value FROM c""",
    "supcon_loss": _LOSS + "SELECT batch, n, round(loss, 6) AS loss FROM b",
    "mean_batch_loss": _LOSS + "SELECT round(avg(loss), 6) AS loss, count(*) AS batches FROM b",
}
