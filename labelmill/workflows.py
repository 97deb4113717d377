"""The four jobs a user runs, each from files to files.

``build_dataset`` turns collected solutions and the label matrix into labelled, split samples; the three
``train_*`` jobs read those samples, fit one model family and write models and metrics.  Each returns
what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.text import code_tokens, ngram_strings, space_tokens
from labelmill.operators import contrastive as con
from labelmill.operators import embeddings as emb
from labelmill.operators import evaluate as ev
from labelmill.operators import labels as lb
from labelmill.operators import models as md
from labelmill.operators import splits as sp
from labelmill.operators import stats
from labelmill.operators import trees as tr
from labelmill.operators.cleaning import clean_code, last_per_key, project_records
from labelmill.sources import nested_json as nj
from labelmill.sources import samples as sm
from labelmill.sources import sinks
from labelmill.vocab import LABEL_CODES, LABELS


def _repository_samples(spark: SparkSession, path: str) -> DataFrame:
    rows = nj.read_nested_solutions(spark, path)
    return rows.select(nj.tag_year(F.col("path")).alias("Year"), F.col("day").alias("Day"), "id",
                       clean_code(F.col("code")).alias("Data"))


def _forum_samples(spark: SparkSession, path: str) -> DataFrame:
    comments = nj.read_thread_solutions(spark, path)
    kept = last_per_key(comments, ["year", "day", "author"], ["pos"])
    return kept.select(F.col("year").alias("Year"), F.col("day").alias("Day"), F.col("author").alias("id"),
                       clean_code(F.col("code")).alias("Data"))


def build_dataset(spark: SparkSession, matrix_csv: str, out: str, leaderboard: str | None = None,
                  forum: str | None = None, repositories: str | None = None, seed: int = 42) -> DataFrame:
    """Collect, clean, label and split.  Sources that are not given are left out.

    Writes ``out/cleaned`` (cleaned code per source), ``out/labelled`` (every label row, also those
    without samples) and ``out/samples`` (non-blank samples partitioned by split and source); returns
    the samples.  Each stage reads the table the one before has written: code is parsed once, the label
    join's key pass reads two columns, and a lost executor repeats one stage at most.
    """
    wide = sm.read_label_matrix(spark, matrix_csv)
    head = [c for c in wide.columns if c not in LABEL_CODES]
    labels = wide.select(*head, lb.marked_columns(LABEL_CODES).alias("Labels"))
    readers: list[tuple[str, str | None, Callable]] = [
        ("leaderboard", leaderboard, _repository_samples), ("reddit", forum, _forum_samples),
        ("github", repositories, _repository_samples),
    ]
    given = [source for source, path, _ in readers if path]
    cleaned = lb.union_sources([(source, read(spark, path)) for source, path, read in readers if path])
    cleaned.write.mode("overwrite").partitionBy("DataSource").parquet(f"{out}/cleaned")
    cleaned = spark.read.parquet(f"{out}/cleaned")
    parts = [
        lb.label_join(labels, cleaned.where(F.col("DataSource") == source), ["Year", "Day"]) for source in given
    ]
    sinks.write_labelled_table(reduce(DataFrame.unionByName, parts), f"{out}/labelled")
    labelled = spark.read.parquet(f"{out}/labelled")
    key = F.concat_ws("/", "DataSource", "Year", "Day", "id")
    split = labelled.withColumn("split", sp.hash_split(key, seed))
    records = project_records(split.select("Year", "Day", "DataSource", "Data", "Labels", "split"), "split")
    sinks.write_samples(records, f"{out}/samples")
    return sm.load_splits(spark, f"{out}/samples", strict=False)


def _finish(spark: SparkSession, fitted: md.LabelModels, parts: dict[str, DataFrame], classes: Sequence[str], out: str,
            labels: str = "Labels") -> DataFrame:
    """Save the models and, per scored part (such as 'test'), metrics, per-label scores and the report; overall, per source
    and per label cardinality.  The models run once per part: predictions are checkpointed before they are summed."""
    fitted.save(f"{out}/models", spark)
    for part, scored in parts.items():
        scored = md.materialise(scored.select("DataSource", labels, "y_pred"))
        by_source = ev.evaluation_summary(scored, classes, labels, slice_col="DataSource")
        cards = scored.withColumn("card", sp.cardinality(F.col(labels))).where(F.col("card").isNotNull())
        by_card = ev.evaluation_summary(cards, classes, labels, slice_col="card", slice_type="cardinality")
        summary = by_source.unionByName(by_card.where(F.col("slice_type") != "overall"))
        where = out if part == "test" else f"{out}/{part}"
        sinks.save_metrics(ev.metrics_long(summary), f"{where}/metrics")
        sinks.save_metrics(ev.per_label(summary), f"{where}/per_label")
        sinks.save_metrics(ev.classification_report(summary), f"{where}/report")
    return spark.read.parquet(f"{out}/metrics")


def _save_search(spark: SparkSession, best: dict, scores: Sequence[tuple[int, int, dict, float]], out: str) -> None:
    """(point, fold, params, score, best) of every fit of a search."""
    rows = [(g, k, json.dumps(p, sort_keys=True), float(s), p == best) for g, k, p, s in scores]
    spark.createDataFrame(rows, "point int, fold int, params string, score double, best boolean").coalesce(1).write.mode(
        "overwrite").parquet(f"{out}/search")


def _with_id(samples: DataFrame) -> DataFrame:
    """Samples with a content key, for folds and per-document counts."""
    key = F.md5(F.concat_ws("/", "DataSource", "Year", "Day", "Data").cast("binary"))
    return samples.withColumn("doc", key)


def train_bag_model(spark: SparkSession, samples: str, out: str, kind: str = "bow", grid: Sequence[dict] | None = None,
                    classes: Sequence[str] = LABEL_CODES, width: int | None = None) -> DataFrame:
    """Bag of words with logistic regression (``kind='bow'``) or trigrams with forests (``'ngram'``).

    Tokens are hashed into ``width`` places.  Three-fold search over the grid by macro F1, refit, metrics on the test split.
    """
    rows = _with_id(sm.load_splits(spark, samples).where(F.col("split") != "val"))
    tokens = code_tokens(F.col("Data")) if kind == "bow" else ngram_strings(space_tokens(F.col("Data")))
    rows = rows.select("doc", "DataSource", "split", "Labels", tokens.alias("tokens"))
    stage = md.hashed_bag("tokens", "features", width or (md.BAG_WIDTH if kind == "bow" else md.FOREST_WIDTH))
    featured = md.materialise(stage.transform(rows).drop("tokens"))
    train, test = (featured.where(F.col("split") == s) for s in ("train", "test"))
    make = md.logistic if kind == "bow" else md.forest
    if grid is None:
        grid = [{"c": md.BOW_C, "max_iter": md.BOW_ITERATIONS}] if kind == "bow" else [{"trees": md.NGRAM_TREES}]
    best, scores, fitted = md.grid_search(train, "doc", "Labels", classes, make, grid)
    _save_search(spark, best, scores, out)
    sinks.save_model(md.feature_pipeline([stage], ["features"], "assembled"), None, f"{out}/features")
    return _finish(spark, fitted, {"test": fitted.predict(test)}, classes, out)


def train_syntax_model(spark: SparkSession, samples: str, out: str, trees: int = md.SYNTAX_TREES,
                       max_features: int = 15_000) -> DataFrame:
    """Syntax-tree features with one balanced forest per label; metrics on the test and the validation split.

    Without a validation split a fifth of train is held out for it.  Columns of hardly any variance are left out.

    Long label names; the vocabulary is the fixed one plus labels found in train.  Writes the data-set
    statistics of the training split next to the metrics.
    """
    rows = sm.load_splits(spark, samples, strict=False).withColumn("Labels", lb.normalise_labels(F.col("Labels")))
    rows = _with_id(rows)
    train = rows.where(F.col("split") == "train")
    stats.label_distribution(train, "Labels").write.mode("overwrite").parquet(f"{out}/label_distribution")
    stats.length_stats(train, F.length("Data")).write.mode("overwrite").parquet(f"{out}/length_stats")
    classes = [r["label"] for r in lb.label_vocabulary(train, "Labels", LABELS).collect()]
    parsed = tr.parse_trees(rows, "Data", "doc", "DataSource", "split", "Labels")
    tree = F.col("tree")
    tokens = md.materialise(parsed.select(
        "doc", "DataSource", "split", "Labels", tr.path_fragments(tree).alias("paths"),
        tr.node_type_words(tree).alias("types"),
        F.coalesce(tr.structural_keys(tree), F.array().cast("array<string>")).alias("shape")))
    fit_on = tokens.where(F.col("split") == "train")
    half = max_features // 2
    stages = [*md.fit_tfidf_stages(fit_on, "doc", "paths", "f_paths", half, md.SYNTAX_MIN_DF),
              *md.fit_tfidf_stages(fit_on, "doc", "types", "f_types", half, md.SYNTAX_MIN_DF),
              md.hashed_bag("shape", "f_shape", md.FOREST_WIDTH)]
    joined = md.feature_pipeline(stages, ["f_paths", "f_types", "f_shape"], "joined")
    features = md.with_variance_selection(joined, joined.transform(fit_on), "joined")
    featured = md.materialise(features.transform(tokens).select("doc", "DataSource", "split", "Labels", "features"))
    part = {s: featured.where(F.col("split") == s) for s in sm.SPLITS}
    if part["val"].isEmpty():
        part["train"], part["val"] = sp.fallback_val_split(part["train"], "doc")
    build = md.forest(trees, md.SYNTAX_DEPTH, md.SYNTAX_MIN_SPLIT, balanced=True)
    fitted = md.fit_labels(part["train"], "Labels", classes, build, min_positives=2)
    sinks.save_model(features, None, f"{out}/features")
    scored = {s: fitted.predict(part[s], md.SYNTAX_THRESHOLD) for s in ("test", "val")}
    return _finish(spark, fitted, scored, classes, out)


def train_embedding_model(spark: SparkSession, samples: str, out: str, load_encoder: Callable | None = None,
                          width: int = 128, grid: Sequence[dict] | None = None, contrastive: bool = False,
                          encoder_folder: str | None = None) -> DataFrame:
    """Dense embeddings with one forest per label, chosen on the validation split by weighted F1.

    ``load_encoder`` is called once per Python worker task; without it word vectors are fitted on train, or with
    ``contrastive`` an encoder whose positives share a label, stopped by its loss on the validation split.  A call with
    the ``encoder_folder`` of an interrupted training on the same samples goes on with it; None starts anew.
    """
    rows = sm.load_splits(spark, samples).withColumn("Labels", sm.clean_labels(F.col("Labels")))
    if load_encoder is None and contrastive:
        encoder = con.fit_encoder(*(rows.where(F.col("split") == s) for s in ("train", "val")), "Data", "Labels", width=width,
                                  folder=encoder_folder)
        vectors = con.embed_with_encoder(rows, "Data", encoder)
    elif load_encoder is None:
        model = emb.fit_word_vectors(rows.where(F.col("split") == "train"), "Data", width)
        vectors = emb.embed_with_words(rows, "Data", model)
    else:
        vectors = rows.withColumn("embedding", emb.unit_embedding(F.col("Data"), load_encoder))
    featured = md.materialise(vectors.select(
        "DataSource", "split", "Labels", F.expr("cast(embedding as array<double>)").alias("embedding")))
    featured = emb.as_features(featured, "embedding")
    classes = [r["label"] for r in lb.label_vocabulary(featured, "Labels").collect()]
    part = {s: featured.where(F.col("split") == s) for s in sm.SPLITS}
    if grid is None:
        grid = [{"trees": md.EMBEDDING_TREES, "depth": md.EMBEDDING_DEPTH, "min_split": md.EMBEDDING_MIN_SPLIT}]
    best, score, fitted = md.best_on_validation(part["train"], part["val"], "Labels", classes, md.forest, grid)
    _save_search(spark, best, [(0, 0, best, score)], out)
    fitted = fitted or md.LabelModels(classes)
    return _finish(spark, fitted, {"test": fitted.predict(part["test"])}, classes, out)
