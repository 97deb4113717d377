"""Inputs of the registered queries, derived by Spark from the given tables, next to the same
derivations in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.labels import marked_columns
from labelmill.session import spread, table


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for a stable comparison; the added zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(*columns))


# ---- templated Python code, one snippet per part --------------------------------------------

# The five code forms.  {k} is the part key, {s} its size.
CODE_FORMS = (
    "def f{k}(x):\n    # note\n    return x + {s}\n",
    'def f{k}(x):\n    """doc"""\n    # note\n    return x + {s}\n',
    "import os\nfrom sys import path\ndef f{k}(x):\n    # note\n    return x + {s}\n",
    "def f{k}(x:\n    return x + {s}\n",
    'def f{k}(x):\n    # note\n    return x + {s}\nprint "done"\n',
)


def fill_form(form: str) -> Column:
    return F.replace(
        F.replace(F.lit(form), F.lit("{k}"), F.col("p_partkey").cast("string")),
        F.lit("{s}"), F.col("p_size").cast("string"),
    )


def by_form(*values: Column) -> Column:
    """The value that belongs to the part's code form."""
    return F.get(F.array(*values), (F.col("p_partkey") % len(values)).cast("int"))


def part_code(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, code)"""
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_size"))
    return parts.select("p_partkey", by_form(*[fill_form(f) for f in CODE_FORMS]).alias("code"))


def sql_text(text: str) -> str:
    """A SQL string literal; newlines are spelled with chr(10)."""
    return "('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def sql_form(*forms: str | None) -> str:
    """SQL: the part's form out of the given ones with its key and size filled in."""
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if f is None else
        f"replace(replace({sql_text(f)}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)")
        for i, f in enumerate(forms)
    )
    return f"CASE p_partkey % {len(forms)} {cases} END"


# ---- true and predicted labels of the labelled documents -------------------------------------

EVAL_CLASSES = ["english", "quality", "toxic", "unused"]
PREDICTED = ["english", "quality", "toxic", "other"]


def predictions(spark: SparkSession, sf: str, *more: Column, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, source, y_true, y_pred, more...): labels table against simple text rules.  'other' is only
    ever predicted and lies outside the evaluated classes; 'unused' never occurs.  ``prepare`` adds columns that ``more`` may name to
    the documents, row by row and before the join."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    docs = prepare(docs) if prepare else docs
    flags = docs.select(
        "doc_id", "source", "lang",
        F.contains("text", F.lit(" the ")).cast("int").alias("english"),
        (F.col("n_chars") > 2000).cast("int").alias("quality"),
        F.contains("text", F.lit("###")).cast("int").alias("toxic"),
        (F.col("n_chars") < 300).cast("int").alias("other"), *more,
    )
    # The rules run before the join, so no text is shuffled.
    names = [c for c in flags.columns if c not in ("doc_id", "source", "lang", *PREDICTED)]
    scored = flags.select("doc_id", "source", "lang", marked_columns(PREDICTED, 1).alias("y_pred"), *names)
    joined = scored.join(table(spark, sf, "labels"), "doc_id")
    truth = joined.withColumn("english", (F.col("lang") == "en").cast("int"))
    return truth.select(
        "doc_id", "source", marked_columns(["english", "quality", "toxic"], 1).alias("y_true"), "y_pred", *names
    )


EVAL_CTE = """
WITH base AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic,
         contains(d.text, ' the ')::INT AS p_english, (d.n_chars > 2000)::INT AS p_quality,
         contains(d.text, '###')::INT AS p_toxic, (d.n_chars < 300)::INT AS p_other
  FROM documents d JOIN labels l USING (doc_id)),
every AS (
  SELECT doc_id, source, 'english' AS label, (lang = 'en')::INT AS y, p_english AS yhat FROM base
  UNION ALL SELECT doc_id, source, 'quality', quality, p_quality FROM base
  UNION ALL SELECT doc_id, source, 'toxic', toxic, p_toxic FROM base
  UNION ALL SELECT doc_id, source, 'unused', 0, 0 FROM base
  UNION ALL SELECT doc_id, source, 'other', 0, p_other FROM base),
sliced AS (
  SELECT 'overall' AS slice_type, 'all' AS slice, doc_id, label, y, yhat FROM every
  UNION ALL SELECT 'source', source, doc_id, label, y, yhat FROM every),
conf AS (
  SELECT slice_type, slice, label, sum(y * yhat)::DOUBLE AS tp, sum((1 - y) * yhat)::DOUBLE AS fp,
         sum(y * (1 - yhat))::DOUBLE AS fn, count(*)::DOUBLE AS n
  FROM sliced WHERE label <> 'other' GROUP BY ALL),
lab AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f
  FROM conf),
docs_ok AS (
  SELECT slice_type, slice, doc_id, bool_and(y = yhat) AS exact, bool_or(y = 1 AND yhat = 1) AS hit
  FROM sliced GROUP BY ALL),
doc_m AS (
  SELECT slice_type, slice, avg(exact::INT) AS exact_match_ratio, avg(hit::INT) AS one_correct_accuracy,
         count(*)::DOUBLE AS sample_count
  FROM docs_ok GROUP BY ALL),
lab_m AS (
  SELECT slice_type, slice,
         CASE WHEN sum(tp + fp) = 0 THEN 0 ELSE sum(tp) / sum(tp + fp) END AS precision_micro,
         CASE WHEN sum(tp + fn) = 0 THEN 0 ELSE sum(tp) / sum(tp + fn) END AS recall_micro,
         CASE WHEN sum(2 * tp + fp + fn) = 0 THEN 0 ELSE 2 * sum(tp) / sum(2 * tp + fp + fn) END AS f1_micro,
         avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro,
         CASE WHEN sum(tp + fn) = 0 THEN 0 ELSE sum(f * (tp + fn)) / sum(tp + fn) END AS f1_weighted,
         CASE WHEN sum(tp + fn) = 0 THEN 0 ELSE sum(p * (tp + fn)) / sum(tp + fn) END AS precision_weighted,
         CASE WHEN sum(tp + fn) = 0 THEN 0 ELSE sum(r * (tp + fn)) / sum(tp + fn) END AS recall_weighted,
         sum(tp + fn) AS support, sum(fp + fn) / sum(n) AS hamming_loss
  FROM lab GROUP BY ALL),
wide AS (SELECT * FROM doc_m JOIN lab_m USING (slice_type, slice)),
tidy AS (
  UNPIVOT (SELECT slice_type, slice, f1_micro::DOUBLE AS f1_micro, f1_macro::DOUBLE AS f1_macro,
                  f1_weighted::DOUBLE AS f1_weighted, precision_micro::DOUBLE AS precision_micro,
                  precision_macro::DOUBLE AS precision_macro, recall_micro::DOUBLE AS recall_micro,
                  recall_macro::DOUBLE AS recall_macro, hamming_loss::DOUBLE AS hamming_loss,
                  exact_match_ratio::DOUBLE AS exact_match_ratio,
                  one_correct_accuracy::DOUBLE AS one_correct_accuracy, sample_count
           FROM wide)
  ON COLUMNS(* EXCLUDE (slice_type, slice)) INTO NAME metric VALUE value)
"""
