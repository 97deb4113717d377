"""Per-label classifiers.

One binary model per label.  Features are built once, checkpointed to the shared folder and read by
every fit, so neither a lost executor nor another label repeats the feature work.  Logistic models of all labels, grid
points and folds are fitted in the same passes (``logistic``); so are the trees of all labels in forests of open depth
(``forests``).  Forests of bounded depth are Spark ML's, those of different labels overlap through a small thread pool, and each fit is
itself distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import let, string_array
from labelmill.functions.hashing import hash_bucket
from labelmill.operators import evaluate as ev
from labelmill.operators import forests as fo
from labelmill.operators import vectors as vec
from labelmill.operators.logistic import LinearModel, Logistic, Spec, fit_all, fold_probabilities, pack, probabilities, sparse_parts
from labelmill.session import materialise, values

BAG_WIDTH = 1 << 18     # hashed tokens of a logistic model
FOREST_WIDTH = 1 << 10  # hashed tokens of a forest, which bins every column of every row

# Model settings.
BOW_C, BOW_ITERATIONS = 10.0, 200
NGRAM_TREES = 100
SYNTAX_TREES, SYNTAX_DEPTH, SYNTAX_MIN_SPLIT, SYNTAX_THRESHOLD, SYNTAX_MIN_DF = 200, 20, 4, 0.5, 2
LEAST_VARIANCE = 0.001 * 0.999
EMBEDDING_TREES, EMBEDDING_DEPTH, EMBEDDING_MIN_SPLIT = 100, 10, 5
SPARK_MAX_DEPTH = 30
FALLBACK_FLOOR = 0.1
SEED = 42


# ---- features --------------------------------------------------------------------------------

def hashed_bag(tokens: str, output: str, width: int = BAG_WIDTH) -> HashingTF:
    """Counts of hashed tokens as a sparse vector of ``width``: nothing is fitted, no term is dropped, and terms share a place
    when there are more of them than places."""
    return HashingTF(inputCol=tokens, outputCol=output, numFeatures=width)


def bag_stage(vocabulary: Sequence[str], tokens: str, output: str) -> CountVectorizerModel:
    """Counts over a fixed vocabulary as a sparse vector; narrow, the vocabulary is bounded by its cap."""
    return CountVectorizerModel.from_vocabulary(list(vocabulary), tokens, output)


def collect_vocabulary(terms: DataFrame, max_features: int, *columns: str) -> list:
    """The capped vocabulary in term order.  At most ``max_features`` rows reach the driver."""
    return sorted(terms.select("term", *columns).limit(max_features).collect(), key=lambda r: r["term"])


def fit_tfidf_stages(train: DataFrame, doc: str, tokens: str, output: str, max_features: int,
                     min_df: int) -> list[Model]:
    """TF-IDF as Spark ML stages: counts x (idf) per term, then unit length."""
    counts = vec.count_terms(train, doc, F.col(tokens))
    idf = vec.fit_tfidf(counts, train.agg(F.count("*")).scalar(), max_features, min_df)
    rows = collect_vocabulary(idf, max_features, "idf")
    raw, scaled = f"_{output}_n", f"_{output}_w"
    weights = Vectors.dense([r["idf"] for r in rows])
    return [
        bag_stage([r["term"] for r in rows], tokens, raw),
        ElementwiseProduct(scalingVec=weights, inputCol=raw, outputCol=scaled),
        Normalizer(p=2.0, inputCol=scaled, outputCol=output),
    ]


def feature_pipeline(stages: Iterable[Model], blocks: Sequence[str], output: str = "features") -> PipelineModel:
    """The stages followed by the concatenation of their blocks."""
    return PipelineModel([*stages, VectorAssembler(inputCols=list(blocks), outputCol=output)])


def with_variance_selection(pipeline: PipelineModel, rows: DataFrame, column: str, output: str = "features",
                            threshold: float = LEAST_VARIANCE) -> PipelineModel:
    """``pipeline`` and a stage that keeps the columns of ``column`` whose variance over ``rows`` is above the threshold; all of
    them when none is.  One pass; the driver gets a number per column."""
    variance = rows.select(Summarizer.variance(F.col(column)).alias("v")).head()["v"]
    kept = [i for i, v in enumerate(variance.toArray()) if v > threshold]
    indices = kept or list(range(len(variance)))
    return PipelineModel([*pipeline.stages, VectorSlicer(inputCol=column, outputCol=output, indices=indices)])


# ---- labels ----------------------------------------------------------------------------------

def trainable_labels(df: DataFrame, labels: str, classes: Sequence[str], min_positives: int = 2) -> DataFrame:
    """(label, positives, trainable): a label with fewer than ``min_positives`` rows is skipped."""
    found = df.select(F.explode(F.array_distinct(F.array_intersect(labels, string_array(classes)))).alias("label"))
    counts = found.groupBy("label").agg(F.count("*").alias("n"))
    listed = values(df.sparkSession, classes, "label")
    n = F.coalesce("n", F.lit(0))
    return listed.join(counts, "label", "left").select(
        "label", n.alias("positives"), (n >= min_positives).alias("trainable")
    )


def count_positives(df: DataFrame, labels: str, classes: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and positives per class in one aggregation."""
    hits = [F.count_if(F.array_contains(labels, c)).alias(f"c{i}") for i, c in enumerate(classes)]
    row = df.agg(F.count("*").alias("n"), *hits).head()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(classes)}


# ---- fitting ---------------------------------------------------------------------------------

Build = Callable[[int, int], Estimator] | Logistic | fo.DeepForest


def logistic(c: float = BOW_C, max_iter: int = BOW_ITERATIONS) -> Logistic:
    """L2 logistic regression of inverse strength ``c``, for all labels at once."""
    return Logistic(c, max_iter)


def forest(trees: int, depth: int | None = None, min_split: int = 2, min_leaf: int = 1, balanced: bool = False,
           seed: int = SEED) -> Build:
    """Random forest with sqrt features.  Spark has no minimum to split a node, so half of it is asked
    of each child; an open depth is Spark's largest, and a larger one is an error.  A forest of open depth has nodes in proportion to
    its rows and is a ``DeepForest``, since Spark ML keeps all nodes in the driver; another one is Spark ML's.  There the nodes that rows
    have reached are kept between the passes, so a pass does not take every row down every tree again; the trees are the same."""
    if depth is None:
        return fo.DeepForest(trees, SPARK_MAX_DEPTH, max(min_leaf, min_split // 2), balanced, seed)
    if depth > SPARK_MAX_DEPTH:
        raise ValueError(f"a forest's depth is at most {SPARK_MAX_DEPTH}, not {depth}")

    def build(n: int, positives: int) -> Estimator:
        extra = {"weightCol": "_w"} if balanced else {}
        return RandomForestClassifier(
            featuresCol="features", labelCol="_y", numTrees=trees, maxDepth=depth,
            minInstancesPerNode=max(min_leaf, min_split // 2), featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True,
            **extra,
        )

    return build


@dataclass
class LabelModels:
    """One fitted model per label; labels without a model have a constant probability."""

    classes: list[str]
    models: dict[str, Model | LinearModel | fo.ForestModel] = field(default_factory=dict)
    constants: dict[str, float] = field(default_factory=dict)

    def probabilities(self, df: DataFrame, output: str = "p") -> DataFrame:
        """Add array<double> with one probability per class: row-local, all models in one stage, but for forests of open depth, whose
        branches the rows meet first."""
        linear = [c for c in self.classes if isinstance(self.models.get(c), LinearModel)]
        if linear:
            df = df.withColumn("_linear", probabilities([self.models[c] for c in linear], F.col("features")))
        deep = self._deep()
        for j, (forest, members) in enumerate(deep):
            df = fo.score(df, forest, [self.models[c].label for c in members], f"_forest{j}")
        columns = []
        for i, c in enumerate(self.classes):
            if c in linear:
                columns.append(F.col("_linear")[linear.index(c)])
            elif isinstance(self.models.get(c), fo.ForestModel):
                j = next(j for j, (_, members) in enumerate(deep) if c in members)
                columns.append(F.col(f"_forest{j}")[deep[j][1].index(c)])
            elif c in self.models:
                model = self.models[c].copy()
                model.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"_p{i}")
                df = model.transform(df)
                columns.append(vector_to_array(f"_p{i}")[1])
            else:
                columns.append(F.lit(self.constants.get(c, 0.0)))
        out = df.withColumn(output, F.array(*columns))
        return out.drop("_linear", *[f"_p{i}" for i in range(len(self.classes))], *[f"_forest{j}" for j in range(len(deep))])

    def _deep(self) -> list[tuple[fo.Forest, list[str]]]:
        """The forests of open depth, each with the classes that it answers."""
        found: dict[int, tuple[fo.Forest, list[str]]] = {}
        for c in self.classes:
            model = self.models.get(c)
            if isinstance(model, fo.ForestModel):
                found.setdefault(id(model.forest), (model.forest, []))[1].append(c)
        return list(found.values())

    def save(self, path: str, spark) -> None:
        """One folder per model and a small table that says which label each folder answers.  Logistic models are one table of the
        coefficients that are not zero, forests of open depth that were fitted together one folder."""
        rows, linear, deep = [], [], self._deep()
        for j, (forest, _) in enumerate(deep):
            forest.save(f"{path}/forest={j}")
        for i, c in enumerate(self.classes):
            model = self.models.get(c)
            kind = ("linear" if isinstance(model, LinearModel) else "forest" if isinstance(model, fo.ForestModel) else
                    "none" if model is None else "spark")
            place = next(((j, model.label) for j, (_, members) in enumerate(deep) if c in members), (None, None))
            rows.append((i, c, kind, self.constants.get(c, 0.0), *place))
            if kind == "spark":
                PipelineModel([model]).write().overwrite().save(f"{path}/label={i}")
            elif kind == "linear":
                linear.append((i, model.width, [int(x) for x in model.slots], [float(x) for x in model.weights], model.intercept))
        listed = spark.createDataFrame(rows, "i int, label string, kind string, constant double, forest int, place int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
        spark.createDataFrame(linear, "i int, width int, slots array<int>, weights array<double>, intercept double").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/linear")

    @classmethod
    def load(cls, path: str, spark) -> LabelModels:
        out, deep = cls([]), {}
        linear = {r["i"]: r for r in spark.read.parquet(f"{path}/linear").collect()}
        for r in sorted(spark.read.parquet(f"{path}/labels").collect(), key=lambda r: r["i"]):
            out.classes.append(r["label"])
            if r["kind"] == "spark":
                out.models[r["label"]] = PipelineModel.load(f"{path}/label={r['i']}").stages[0]
            elif r["kind"] == "forest":
                if r["forest"] not in deep:
                    deep[r["forest"]] = fo.Forest.load(f"{path}/forest={r['forest']}", spark)
                out.models[r["label"]] = fo.ForestModel(deep[r["forest"]], r["place"])
            elif r["kind"] == "linear":
                m = linear[r["i"]]
                out.models[r["label"]] = LinearModel(
                    m["width"], np.array(m["slots"], np.int64), np.array(m["weights"], float), m["intercept"])
            elif r["constant"]:
                out.constants[r["label"]] = r["constant"]
        return out

    def predict(self, df: DataFrame, threshold: float | None = None, output: str = "y_pred") -> DataFrame:
        """Label list per row; without a threshold a label needs more than one half."""
        scored = self.probabilities(df)
        labels = above_half("p", self.classes) if threshold is None else assign_labels("p", self.classes, threshold)
        return scored.withColumn(output, labels)


def fit_labels(train: DataFrame, labels: str, classes: Sequence[str], build: Build, min_positives: int = 1,
               parallelism: int = 4, max_rows: int | None = None) -> LabelModels:
    """Fit one binary model per class on ``train(features, labels)``.

    All rows are fitted on.  ``max_rows`` refuses a forest, whose size grows with its rows, on more rows than that; logistic models
    do not grow.

    A class with too few positives is skipped (probability 0); one that every row has is constant 1.
    """
    if isinstance(build, Logistic):
        return fit_logistic(train, labels, classes, [build], min_positives)[-1][0]
    n, positives = count_positives(train, labels, classes)
    if max_rows is not None and n > max_rows:
        raise ValueError(f"a forest on {n} rows, {max_rows} allowed")
    fitted = LabelModels(list(classes))
    todo = []
    for c in classes:
        if positives[c] < min_positives or positives[c] == 0:
            continue
        if positives[c] == n:
            fitted.constants[c] = 1.0
        else:
            todo.append(c)

    truth = {c: F.coalesce(F.array_contains(labels, c), F.lit(False)) for c in todo}
    if isinstance(build, fo.DeepForest):
        fitted.models = dict(zip(todo, fo.fit_forests(train, list(truth.values()), build, n, [positives[c] for c in todo])))
        return fitted

    def fit(c: str) -> Model:
        y = truth[c]
        weight = F.when(y, n / (2.0 * positives[c])).otherwise(n / (2.0 * (n - positives[c])))
        rows = train.select("features", y.cast("double").alias("_y"), weight.alias("_w"))
        return build(n, positives[c]).fit(rows)

    # Each thread gets its own copy of the session's job tags and properties.
    in_session = inheritable_thread_target(train.sparkSession)
    with ThreadPoolExecutor(max(1, min(parallelism, len(todo) or 1))) as pool:
        jobs = {c: pool.submit(in_session(fit), c) for c in todo}
        fitted.models = {c: job.result() for c, job in jobs.items()}
    return fitted


def fit_logistic(train: DataFrame, labels: str, classes: Sequence[str], settings: Sequence[Logistic], min_positives: int = 1,
                 folds: str | None = None) -> dict[int, list[LabelModels]]:
    """The models of every setting in one fit: on all rows (key -1), or with a column ``folds``, on the rows outside each fold.

    Classes that are too rare among the fitted rows have probability 0 there, those of every row 1, as in ``fit_labels``.
    """
    fold = F.lit(-2) if folds is None else F.col(folds).cast("int")
    y = F.array(*[F.coalesce(F.array_contains(labels, c), F.lit(False)) for c in classes])
    slots, values = sparse_parts(F.col("features"))
    rows = train.select(slots.alias("slots"), values.alias("values"), y.alias("labels"), fold.alias("fold"),
                        F.unwrap_udt("features")["size"].alias("size"))
    hits = [F.count_if(F.col("labels")[i]).alias(f"c{i}") for i in range(len(classes))]
    width = F.max(F.coalesce("size", F.size("values"))).alias("width")
    counts = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), width, *hits).collect()}
    n = {k: r["n"] for k, r in counts.items()}
    models: dict[int, list[LabelModels]] = {
        k: [LabelModels(list(classes)) for _ in settings] for k in (sorted(counts) if folds else [-1])}
    specs = {}
    for k, fitted in models.items():
        inside = [r for f, r in counts.items() if f != k]
        fit_on = sum(r["n"] for r in inside)
        for i, c in enumerate(classes):
            positives = sum(r[f"c{i}"] for r in inside)
            if positives < max(min_positives, 1):
                continue
            for g, setting in enumerate(settings):
                if positives == fit_on:
                    fitted[g].constants[c] = 1.0
                else:
                    specs[k, g, c] = Spec(i, k, setting)
    if specs:
        size = max(r["width"] for r in counts.values())
        found = fit_all(pack(rows, size), size, list(dict.fromkeys(specs.values())), n)
        for (k, g, c), spec in specs.items():
            models[k][g].models[c] = found[spec]
    return models


# ---- label assignment ------------------------------------------------------------------------

def above_half(p: str, classes: Sequence[str]) -> Column:
    names = string_array(classes)
    return F.filter(names, lambda c, i: F.get(F.col(p), i) > 0.5)


def assign_labels(p: str, classes: Sequence[str], threshold: float, floor: float = FALLBACK_FLOOR) -> Column:
    """Labels with p >= threshold; when there are none, the most probable one if it exceeds the floor
    (the first class wins a tie)."""
    names = string_array(classes)
    best = F.array_max(F.col(p))
    single = F.when(best > floor, F.array(F.get(names, F.array_position(p, best).cast("int") - 1)))
    chosen = F.filter(names, lambda c, i: F.get(F.col(p), i) >= threshold)
    return let(chosen, lambda k: F.when(F.size(k) > 0, k).otherwise(
        F.coalesce(single, F.array().cast("array<string>"))))


# ---- search ----------------------------------------------------------------------------------

def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


# The search grids.
FOREST_GRID = {"trees": [100, 200], "depth": [None, 10, 20], "min_split": [2, 5], "min_leaf": [1, 2]}
LOGISTIC_GRID = {"c": [0.1, 1.0, 10.0], "max_iter": [100, 200]}


def grid_search(train: DataFrame, key: str, labels: str, classes: Sequence[str], make: Callable[..., Build],
                grid: Sequence[dict], folds: int = 3, seed: int = SEED, metric: str = "f1_macro",
                refit: bool = True) -> tuple[dict, list[tuple[int, int, dict, float]], LabelModels | None]:
    """(best parameters, scores, model refitted on all of ``train`` unless ``refit`` is false).

    A row's fold is a hash of its key.  A score is the metric over all labels jointly on the held-out
    fold; the best mean wins, the earlier grid point on a tie.  Logistic models of all points and folds are fitted in the same
    passes and scored in one.
    """
    df = train.withColumn("_fold", (hash_bucket(F.col(key), seed) % folds).cast("int"))
    builds = [make(**params) for params in grid]
    if all(isinstance(b, Logistic) for b in builds):
        scores = _logistic_scores(df, labels, classes, builds, folds, metric)
    else:
        scores = {}
        for (g, build), k in product(enumerate(builds), range(folds)):
            fitted = fit_labels(df.where(F.col("_fold") != k), labels, classes, build)
            held = fitted.predict(df.where(F.col("_fold") == k))
            row = ev.metrics_wide(ev.evaluation_summary(held, classes, labels, "y_pred")).head()
            scores[g, k] = 0.0 if row is None else float(row[metric])
    listed = [(g, k, grid[g], scores.get((g, k), 0.0)) for g in range(len(grid)) for k in range(folds)]
    means = [sum(s for g, _, _, s in listed if g == i) / folds for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: (means[i], -i))
    return grid[best], listed, fit_labels(train, labels, classes, builds[best]) if refit else None


def _logistic_scores(df: DataFrame, labels: str, classes: Sequence[str], settings: Sequence[Logistic], folds: int,
                     metric: str) -> dict[tuple[int, int], float]:
    """(point, fold) -> metric on the held-out fold: every row is scored by all points' models of its fold at once."""
    fitted = fit_logistic(df, labels, classes, settings, folds="_fold")
    width = max((m.width for points in fitted.values() for p in points for m in p.models.values()), default=0)
    flat = {}
    for k, points in fitted.items():
        flat[k] = [p.models.get(c) or LinearModel(width, np.zeros(0, np.int64), np.zeros(0), 500.0 if p.constants.get(c) else -500.0)
                   for p in points for c in classes]
    if not flat:
        return {}
    scored = df.withColumn("_p", fold_probabilities(flat, F.col("features"), F.col("_fold")))
    n = len(classes)
    points = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(settings) - 1)), lambda g: F.slice("_p", g * n + 1, n)))
    each = scored.select(F.col(labels).alias("y_true"), "_fold", points.alias("_g", "p")).select(
        "y_true", above_half("p", classes).alias("y_pred"), F.concat_ws("/", "_g", "_fold").alias("_part"))
    rows = ev.metrics_wide(ev.evaluation_summary(each, classes, slice_col="_part")).where("slice_type <> 'overall'").collect()
    return {tuple(map(int, r["slice"].split("/"))): float(r[metric]) for r in rows}


def best_on_validation(train: DataFrame, val: DataFrame, labels: str, classes: Sequence[str],
                       make: Callable[..., Build], grid: Sequence[dict], metric: str = "f1_weighted",
                       ) -> tuple[dict, float, LabelModels | None]:
    """The grid point with the highest validation metric; it must be above 0 to be chosen."""
    best: tuple[dict, float, LabelModels | None] = ({}, 0.0, None)
    for params in grid:
        fitted = fit_labels(train, labels, classes, make(**params))
        row = ev.metrics_wide(ev.evaluation_summary(fitted.predict(val), classes, labels, "y_pred")).head()
        score = 0.0 if row is None else float(row[metric])
        if score > best[1]:
            best = (params, score, fitted)
    return best
