"""Registered queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from labelmill.llm import (
    content, decontaminate, langid, licenses, minhash, mixing, mixlm, pii, runs, spelling, toxicity, urls, vectors,
)
from labelmill.session import table


def op1_lm_scoring(spark, sf):
    return mixlm.score_documents(table(spark, sf, "documents"))


def op2_toxicity(spark, sf):
    return toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_decontaminate(spark, sf):
    return decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_language_id(spark, sf):
    return langid.digest(table(spark, sf, "documents"))


def op5_vector_near_dup(spark, sf):
    return vectors.link_vectors(table(spark, sf, "embeddings"))


def op6_license_scan(spark, sf):
    return licenses.digest(table(spark, sf, "documents"))


def op7_mix_sources(spark, sf):
    return mixing.mixed_counts(table(spark, sf, "documents"))


def op8_pii(spark, sf):
    return pii.digest(table(spark, sf, "documents"))


def op9_minhash_near_dup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), width=4)


def op10_url_filter(spark, sf):
    return urls.digest(table(spark, sf, "pages"))


def op11_html_content(spark, sf):
    return content.digest(table(spark, sf, "pages"))


def op12_periodic_runs(spark, sf):
    return runs.digest(table(spark, sf, "documents"))


def op13_spelling_variants(spark, sf):
    return spelling.digest(table(spark, sf, "documents"))


def pipeline(spark, sf):
    """The stages of corpus_pipeline.py, one after another."""
    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_toxicity, op3_decontaminate, op4_language_id, op5_vector_near_dup, op6_license_scan,
        op7_mix_sources, op8_pii, op9_minhash_near_dup, op10_url_filter, op11_html_content,
        op12_periodic_runs, op13_spelling_variants, pipeline,
    )
}
ORACLES = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_vector_near_dup": vectors.ORACLE,
    "op9_minhash_near_dup": minhash.ORACLE,
    "op10_url_filter": urls.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
