"""Registered queries: sample records, label matrix, label joins, multi-hot forms, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions.arrays import string_array
from labelmill.functions.hashing import hash_bucket
from labelmill.operators import labels as lb
from labelmill.operators import splits as sp
from labelmill.operators.cleaning import last_per_key
from labelmill.plans.inputs import documents
from labelmill.session import table
from labelmill.sources import samples as sm
from labelmill.vocab import LABEL_CODES, LABEL_NAMES, LABELS

MARKS = ["quality", "toxic"]


def _joined(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


def sample_normalise(spark, sf):
    """Two record styles: French rows keep their code under the second key, German rows are blank."""
    fr, de = F.col("lang") == "fr", F.col("lang") == "de"
    data = F.when(de, F.lit(" \n\t")).when(~fr, F.col("text"))
    raw = _joined(spark, sf).select(
        "doc_id", data.alias("Data"), F.when(fr, F.col("text")).alias("code"),
        F.when(F.col("quality").isNotNull(), F.concat(
            F.array(F.when(F.col("quality") == 1, "quality")), F.array(F.when(F.col("toxic") == 1, "toxic")),
            F.array(F.lit(" ")))).alias("Labels"),
    )
    out = sm.normalise_samples(raw, F.coalesce("Data", "code"), F.col("Labels"), "doc_id")
    return out.select("doc_id", F.md5("code").alias("code_md5"), F.concat_ws(",", "labels").alias("labels"))


def label_string_parse(spark, sf):
    """Label text as a JSON list for English rows, comma separated for the others."""
    q, t = F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")
    as_json = F.to_json(F.filter(F.array(q, t), lambda x: x.isNotNull()))
    as_text = F.concat_ws(" , ", q, F.lit(""), t)
    df = _joined(spark, sf).where(F.col("quality").isNotNull())
    parsed = sm.parse_label_text(F.when(F.col("lang") == "en", as_json).otherwise(as_text))
    return df.select("doc_id", F.concat_ws(",", parsed).alias("labels"), F.size(parsed).cast("bigint").alias("n"))


def label_matrix_to_array(spark, sf):
    out = lb.matrix_to_labels(table(spark, sf, "labels").select(
        "doc_id", *[F.when(F.col(m) == 1, "X").alias(m) for m in MARKS]), ["doc_id"], MARKS)
    return out.select("doc_id", F.concat_ws(",", "Labels").alias("labels"))


def attach_labels(spark, sf):
    """Labels with one duplicate row per document; the first row of a key wins."""
    wide = table(spark, sf, "labels")
    arrays = lb.matrix_to_labels(wide.select("doc_id", *MARKS), ["doc_id"], MARKS, 1)
    doubled = arrays.withColumn("pos", F.lit(0)).unionByName(
        arrays.select("doc_id", F.array(F.lit("late")).alias("Labels"), F.lit(1).alias("pos"))
    )
    first = lb.first_row_per_key(doubled, ["doc_id"], "pos")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    out = lb.attach_labels(docs, first, ["doc_id"])
    return out.select("doc_id", "source", F.concat_ws(",", "Labels").alias("labels"))


def label_left_join(spark, sf):
    """Nations as label rows, suppliers as samples with a shifted key: some of either are unmatched."""
    labels = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    samples = table(spark, sf, "supplier").select((F.col("s_nationkey") + 5).alias("key"), "s_suppkey", "s_name")
    return lb.label_join(labels, samples, ["key"])


def union_sources(spark, sf):
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    return lb.union_sources([
        ("leaderboard", c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
                                 F.col("c_acctbal").alias("acctbal"))),
        ("reddit", s.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
                            F.col("s_acctbal").alias("acctbal"))),
        ("github", n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))),
    ])


def label_normalise(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    n = F.size(string_array(LABEL_CODES))
    code = F.get(string_array(LABEL_CODES), (F.col("p_size") % n).cast("int"))
    name = F.get(string_array(LABELS), (F.col("p_partkey") % n).cast("int"))
    loose = F.initcap(F.translate(name, "_", "-"))
    raw = F.array("p_type", F.lit("  "), F.concat(F.lit(" "), code, F.lit(" ")), name, loose,
                  F.concat("p_brand", F.lit(" x")))
    return part.select("p_partkey", F.concat_ws("|", lb.normalise_labels(raw)).alias("labels"))


def label_vocab(spark, sf):
    docs = table(spark, sf, "documents").select(F.array("lang", "source").alias("labels"))
    return lb.label_vocabulary(docs, "labels", ["en", "zz_known", "it"])


def _arrays(spark, sf):
    tags = F.concat(lb.marked_columns(MARKS, 1), F.array("lang"))
    return _joined(spark, sf).select("doc_id", tags.alias("labels"))


CLASSES = ["en", "fr", "quality", "toxic", "unused"]


def multi_hot(spark, sf):
    return _arrays(spark, sf).select("doc_id", *lb.multi_hot(F.col("labels"), CLASSES))


def multi_hot_long(spark, sf):
    return lb.multi_hot_long(_arrays(spark, sf), "labels", CLASSES, "doc_id")


def label_string(spark, sf):
    wide = _arrays(spark, sf).select("doc_id", *lb.multi_hot(F.col("labels"), CLASSES))
    return wide.select("doc_id", lb.label_string(CLASSES).alias("label"))


def last_per_user(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return last_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


def hash_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.select("doc_id", hash_bucket(F.col("doc_id"), 42).alias("bucket"),
                       sp.hash_split(F.col("doc_id")).alias("split"))


def split_sizes(spark, sf):
    docs = table(spark, sf, "documents").select(sp.hash_split(F.col("doc_id")).alias("split"))
    return sp.split_sizes(docs)


def exact_split(spark, sf):
    docs = documents(spark, sf, "doc_id")
    return sp.exact_split(docs, "doc_id").select("doc_id", "split")


QUERIES = {
    f.__name__: f
    for f in (
        sample_normalise, label_string_parse, label_matrix_to_array, attach_labels, label_left_join,
        union_sources, label_normalise, label_vocab, multi_hot, multi_hot_long, label_string, last_per_user,
        hash_split, split_sizes, exact_split,
    )
}

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LABEL_NAMES.items()) + "}"
_CODES = "[" + ", ".join(f"'{k}'" for k in LABEL_CODES) + "]"
_NAMES = "[" + ", ".join(f"'{v}'" for v in LABELS) + "]"
_SPLIT_CTE = """
WITH b AS (SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10000 AS bucket FROM documents),
s AS (SELECT *, CASE WHEN bucket < 1000 THEN 'test' WHEN bucket < 2000 THEN 'val' ELSE 'train' END AS split FROM b)
"""
_ARRAYS_CTE = """
WITH a AS (SELECT doc_id, lang, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS t
           FROM documents LEFT JOIN labels USING (doc_id))
"""

ORACLES = {
    "sample_normalise": """
SELECT doc_id, md5(text) AS code_md5,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'quality,toxic' WHEN quality = 1 THEN 'quality'
       WHEN toxic = 1 THEN 'toxic' ELSE 'Unknown' END AS labels
FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'de' AND trim(text) <> ''""",
    "label_string_parse": """
SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS labels,
       (quality + toxic)::BIGINT AS n
FROM documents JOIN labels USING (doc_id)""",
    "label_matrix_to_array": """
SELECT doc_id, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS labels
FROM labels""",
    "attach_labels": """
SELECT doc_id, source,
  concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS labels
FROM documents LEFT JOIN labels USING (doc_id)""",
    "label_left_join": """
SELECT n_nationkey AS key, n_name, s_suppkey, s_name
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey + 5""",
    "union_sources": """
SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS acctbal, 'leaderboard' AS "DataSource" FROM customer
UNION ALL SELECT s_name, s_nationkey, s_acctbal, 'reddit' FROM supplier
UNION ALL SELECT n_name, n_nationkey, NULL, 'github' FROM nation""",
    "label_normalise": f"""
SELECT p_partkey, concat_ws('|', lower(replace(p_type, ' ', '_')), {_MAP}[{_CODES}[p_size % 22 + 1]],
  {_NAMES}[p_partkey % 22 + 1], {_NAMES}[p_partkey % 22 + 1], lower(p_brand) || '_x') AS labels FROM part""",
    "label_vocab": """
SELECT lang AS label FROM documents UNION SELECT source FROM documents
UNION SELECT unnest(['en', 'zz_known', 'it'])""",
    "multi_hot": _ARRAYS_CTE + """
SELECT doc_id, (lang = 'en')::INT AS en, (lang = 'fr')::INT AS fr, q AS quality, t AS toxic, 0 AS unused FROM a""",
    "multi_hot_long": _ARRAYS_CTE + """
SELECT doc_id, 'en' AS label, (lang = 'en')::INT AS y FROM a
UNION ALL SELECT doc_id, 'fr', (lang = 'fr')::INT FROM a UNION ALL SELECT doc_id, 'quality', q FROM a
UNION ALL SELECT doc_id, 'toxic', t FROM a UNION ALL SELECT doc_id, 'unused', 0 FROM a""",
    "label_string": _ARRAYS_CTE + """
SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN lang IN ('en', 'fr') THEN lang END,
  CASE WHEN q = 1 THEN 'quality' END, CASE WHEN t = 1 THEN 'toxic' END), ''), 'No Label') AS label FROM a""",
    "last_per_user": """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
    "hash_split": _SPLIT_CTE + "SELECT doc_id, bucket, split FROM s",
    "split_sizes": _SPLIT_CTE + "SELECT split, count(*) AS n FROM s GROUP BY split",
    "exact_split": """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(0.8::DOUBLE * n) THEN 'train'
  WHEN k <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r""",
}
