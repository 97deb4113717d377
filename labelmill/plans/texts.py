"""Registered queries: text cleaning, tokens, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.operators.cleaning import keep_nonblank
from labelmill.operators.grams import top_ngrams
from labelmill.plans.inputs import documents, rounded


def strip_imports(spark, sf):
    """Every sentence start becomes a line that begins with 'from ', between two import blocks."""
    head, tail = "import os\n\n \t\nfrom a import b\n", "\n  import (x,\n y)\nimportant = 1\nfrom  \n"
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n from "))
    code = F.concat(F.lit(head), body, F.lit(tail))
    out = documents(spark, sf, "doc_id", "text").select("doc_id", tx.strip_imports(code).alias("c"))
    return out.select("doc_id", F.md5("c").alias("code_md5"), F.length("c").cast("bigint").alias("n"))


def nonblank(spark, sf):
    blank = F.concat(F.lit(" \n"), F.lit(chr(160)), F.lit(chr(0x2003)))
    df = documents(spark, sf, "doc_id", "lang", "text").select(
        "doc_id", F.when(F.col("lang") == "de", blank).when(F.col("lang") != "es", F.col("text")).alias("code")
    )
    return keep_nonblank(df, "code").select("doc_id", F.length("code").cast("bigint").alias("n"))


def snippet_preview(spark, sf):
    return documents(spark, sf, "doc_id", "text").select("doc_id", tx.truncate_snippet(F.col("text")).alias("snippet"))


def _token_digest(spark, sf, tokens):
    df = documents(spark, sf, "doc_id", "text").select("doc_id", tokens(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.concat_ws(" ", "t")).alias("tokens_md5"))


def code_tokens(spark, sf):
    return _token_digest(spark, sf, tx.code_tokens)


def tfidf_tokens(spark, sf):
    return _token_digest(spark, sf, tx.tfidf_tokens)


def ngram_lists(spark, sf):
    """The n-gram lists of every document, digested."""
    grams = F.transform(tx.token_ngrams(tx.space_tokens(F.col("text"))), lambda g: F.concat_ws(" ", g))
    df = documents(spark, sf, "doc_id", "text").select("doc_id", grams.alias("g"))
    return df.select("doc_id", F.size("g").cast("bigint").alias("n"), F.md5(F.concat_ws("|", "g")).alias("grams_md5"))


def token_ngrams(spark, sf, k: int = 10):
    """The k most frequent trigrams per language."""
    return top_ngrams(documents(spark, sf, "lang", "text"), "lang", tx.space_tokens(F.col("text")), k)


def tf_l2_per_doc(spark, sf):
    weights = F.explode(tx.doc_tf_l2(tx.tfidf_tokens(F.col("text")))).alias("w")
    out = documents(spark, sf, "doc_id", "text").select("doc_id", weights).select("doc_id", "w.*")
    return rounded(out, "weight")


QUERIES = {
    f.__name__: f
    for f in (
        strip_imports, nonblank, snippet_preview, code_tokens, tfidf_tokens, ngram_lists, token_ngrams, tf_l2_per_doc,
    )
}

# White space of the text functions, in RE2 spelling.
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
TFIDF_SQL = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|==|!=|<=|>=|[-+*/%=(){}\[\]:.,]"
CODE_SQL = r"[\p{L}\p{N}_]+|[+\-*/=<>!&|]+|[(){}\[\];,.]"
GRAMS_CTE = f"""
WITH t AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, lang, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 3),
g AS (SELECT doc_id, lang, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram FROM i)
"""

ORACLES = {
    "strip_imports": f"""
WITH c AS (SELECT doc_id, regexp_replace(
  'import os' || chr(10) || chr(10) || ' ' || chr(9) || chr(10) || 'from a import b' || chr(10)
  || replace(text, '. ', '.' || chr(10) || ' from ')
  || chr(10) || '  import (x,' || chr(10) || ' y)' || chr(10) || 'important = 1' || chr(10) || 'from  ' || chr(10),
  '(?m)^{WS}*(import|from){WS}+[^\\n]+', '', 'g') AS c FROM documents)
SELECT doc_id, md5(c) AS code_md5, length(c)::BIGINT AS n FROM c""",
    "nonblank": f"""
SELECT doc_id, length(text)::BIGINT AS n FROM documents
WHERE lang NOT IN ('de', 'es') AND regexp_replace(text, '{WS}', '', 'g') <> ''""",
    "snippet_preview": """
SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS snippet
FROM documents""",
    "code_tokens": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{CODE_SQL}', 0) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""",
    "tfidf_tokens": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TFIDF_SQL}', 0) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""",
    "ngram_lists": GRAMS_CTE + """
SELECT doc_id, count(gram)::BIGINT AS n, md5(coalesce(string_agg(gram, '|' ORDER BY k), '')) AS grams_md5
FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id""",
    "token_ngrams": GRAMS_CTE + """,
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)::INT AS rank FROM c)
SELECT lang, gram, n, rank FROM r WHERE rank <= 10""",
    "tf_l2_per_doc": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TFIDF_SQL}', 0)) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS cnt FROM t GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(cnt * cnt)::DOUBLE) AS norm FROM c GROUP BY doc_id)
SELECT doc_id, term, round(cnt / norm, 6) AS weight FROM c JOIN n USING (doc_id)""",
}
