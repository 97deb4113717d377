"""Toxicity: logistic regression on word presence with a counterfactual penalty.

For every labelled text with an identity term, copies are made in which the term is swapped for the others of its
group.  The copies should score like the original, so the squared changes of the score (before the logistic
function) are penalised; a group's mere mention cannot carry weight.  The swaps happen in the tasks and arrive as
counts of (features that went, features that came), which is all the penalty needs.

Fitting uses a bounded sample of labelled documents: at most about ``sample_rows`` of each label, chosen by a hash
of the key.  Features are the words whose presence differs most between the labels, ``max_features`` at most, and the
identity terms.  Scoring reads the whole text of every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import checkpoint, held_out
from labelmill.llm.decontaminate import words_of

SAMPLE_ROWS, MAX_FEATURES = 10_000, 4096
MIN_DOCS, LEAST_Z = 4, 4.5
RIDGE, FAIRNESS = 1.0, 50.0
# Identity terms in groups; a term is swapped for the others of its group.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("immigrants", "refugees", "citizens", "foreigners"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("extranjeros", "españoles"),
)
SWAPS = {w.encode(): [x.encode() for x in g if x != w] for g in IDENTITY_GROUPS for w in g}


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in set(words_of(text)))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))


def _sampled(labels: DataFrame, n: int) -> DataFrame:
    """(key, y): about ``n`` keys of each label."""
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    keep = [min(1.0, n / sizes[y]) if sizes.get(y) else 0.0 for y in (0, 1)]
    return labels.where(share < F.when(F.col("y") == 1, keep[1]).otherwise(keep[0]))


def _distinct_words(text: Column) -> Column:
    @F.pandas_udf("array<binary>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(set(words_of(t))) for t in texts], dtype=object)

    return words(text)


def swapped(words: set[bytes]) -> Iterator[tuple[bytes, bytes | None]]:
    """(term that goes, term that comes or None if it is there already) of every counterfactual copy."""
    for w in words & SWAPS.keys():
        for other in SWAPS[w]:
            yield w, None if other in words else other


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, fairness: float = FAIRNESS) -> Model:
    """Fit on the documents whose key has a label 0 or 1.  A key with several labels counts as 1 if any is; null keys,
    labels and texts are ignored.  Without labelled rows of both kinds, every text scores the share of 1s (0.5 if none)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("y"))
    chosen = F.broadcast(_sampled(known, sample_rows))  # about 2 x sample_rows keys at most
    rows = checkpoint(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
                      .join(chosen, "key").select("y", _distinct_words(F.col("text")).alias("words")))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else 0.0)
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1.0), (F.col("c0") + 0.5) / (n0 + 1.0)
    even = (F.col("c0") + F.col("c1") + 1.0) / (n0 + n1 + 2.0)
    z = F.abs(p1 - p0) / F.sqrt(even * (1.0 - even) * (1.0 / n0 + 1.0 / n1))
    tally = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    telling = tally.where((F.col("c0") + F.col("c1") >= MIN_DOCS) & (z >= LEAST_Z)).orderBy(F.desc(z), "word")
    features = [bytes(r["word"]) for r in telling.limit(max_features).collect()]
    features += [w for w in sorted(SWAPS) if w not in set(features)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: i for i, w in enumerate(features)}
        for frame in batches:
            out = []
            for y, words in zip(frame["y"], frame["words"]):
                have = set(map(bytes, words))
                pairs = [(number[a], number[b] if b else -1) for a, b in swapped(have)]
                out.append((y, [number[w] for w in have if w in number], [x for p in pairs for x in p]))
            yield pd.DataFrame(out, columns=["y", "on", "swaps"])

    design = rows.mapInPandas(encode, "y int, on array<int>, swaps array<int>").toPandas()
    swaps = Counter(p for s in design["swaps"] for p in zip(s[::2], s[1::2]))
    weights, bias = _minimise(design["y"].to_numpy(float), list(design["on"]), len(features), swaps, fairness)
    return Model({w: float(x) for w, x in zip(features, weights) if x}, float(bias))


def _minimise(y: np.ndarray, on: list[np.ndarray], width: int, swaps: Counter, fairness: float,
              steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss, both labels weighing the same, + ridge + mean squared score change of the counterfactual
    copies; full-batch gradient descent with per-coordinate step sizes."""
    row = np.repeat(np.arange(len(on)), [len(x) for x in on])
    col = np.concatenate([np.asarray(x, np.int64) for x in on]) if len(row) else np.zeros(0, np.int64)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    gone, come, times = (np.array(x) for x in zip(*((a, b, n) for (a, b), n in swaps.items()))) if swaps else (
        np.zeros(0, np.int64),) * 3
    times = times / max(1, times.sum())
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1.0 / (1.0 + np.exp(-(b + np.bincount(row, w[col], len(y)))))
        err = share * (p - y)
        grad = np.bincount(col, err[row], width) + RIDGE * w / len(y)
        change = np.where(come >= 0, w[come], 0.0) - w[gone]
        force = 2.0 * fairness * times * change
        grad -= np.bincount(gone, force, width)
        grad += np.bincount(come[come >= 0], force[come >= 0], width)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def predict(text: Column, model: Model) -> Column:
    """The score of the whole text, 0 to 1; null counts as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return score(text)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels only of rows that are not held out."""
    out = held_out(F.col("doc_id"), 5)
    model = fit(docs.select("doc_id", "text").where(~out), labels.select("doc_id", "toxic").where(~out))
    return docs.select("doc_id", out.alias("held_out"), predict(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
