"""Many L2 logistic regressions in the same passes over the data.

All models of a fit (labels x grid points x folds) share their rows, so one pass evaluates the loss and gradient of all of
them: rows are packed once into blocks of sparse arrays, a task multiplies its blocks by the matrix of all coefficients, and the
tasks' gradients are summed in pieces of the matrix by streams of one shuffle.  The driver keeps an L-BFGS state per model; each
tries its own next point in the next pass, whatever the others do, and leaves when it has converged.

Only places that occur have coefficients.  Bounds: a pass holds ``PASS_COEFFICIENTS`` coefficients (10 MB) at most, so a task and the shuffle get that much whatever the
number of rows; more models are fitted group after group.  What is broadcast is that matrix.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.session import ensure_checkpoint_dir

PASS_COEFFICIENTS = 5 << 18
BLOCK_ENTRIES = 1 << 15     # entries of a packed block
HISTORY = 10
PATIENCE, STALL = 5, 0.01    # a search ends when so many iterations have lowered its loss by no more than this share
_PIECE = 1 << 13            # coefficients of a gradient piece
_BLOCK = "labels binary, folds binary, by_row binary, row_values binary, row_starts binary, slots binary, slot_starts binary, " \
         "by_slot binary, slot_values binary"


@dataclass(frozen=True)
class Logistic:
    """L2 logistic regression with inverse strength ``c``; the intercept is not penalised."""

    c: float = 10.0
    max_iter: int = 200
    tol: float = 1e-4


@dataclass(frozen=True)
class Spec:
    """One model: label number, the fold left out of its fit (-1: none), settings."""

    label: int
    fold: int
    settings: Logistic


@dataclass
class LinearModel:
    """Coefficients of one label: the places that are not zero, their weights, the intercept."""

    width: int
    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    @classmethod
    def of(cls, width: int, used: np.ndarray, coefficients: np.ndarray) -> LinearModel:
        """From the coefficients of the ``used`` places, the last of which is the intercept's."""
        some = np.flatnonzero(coefficients[:-1])
        return cls(width, used[some], coefficients[some], float(coefficients[-1]))

    def dense(self) -> np.ndarray:
        out = np.zeros(self.width + 1)
        out[self.slots] = self.weights
        out[-1] = self.intercept
        return out


# ---- rows ------------------------------------------------------------------------------------

def sparse_parts(features: Column) -> list[Column]:
    """Places and values of a vector column, as arrays that need no Python object per vector.  A dense vector has all places."""
    v = F.unwrap_udt(features)
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return [F.when(F.size(v["values"]) > 0, places).otherwise(F.array().cast("array<int>")), v["values"]]


def pack(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of ``rows(slots, values, labels array<boolean>, fold)``, kept in the shared checkpoint folder.  A row gets one more entry,
    1 at the place ``width``, for the intercept.  They lie in as many partitions as there are cores at most: every task of a pass sends a
    gradient, so what a pass shuffles does not grow with the rows."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, entries = [], 0
        for batch in batches:
            for slots, values, labels, fold in batch[["slots", "values", "labels", "fold"]].itertuples(index=False):
                held.append((slots, values, labels, fold))
                entries += len(slots) + 1
                if entries >= BLOCK_ENTRIES:
                    yield _block(held, width)
                    held, entries = [], 0
        if held:
            yield _block(held, width)

    ensure_checkpoint_dir(rows.sparkSession)
    return rows.mapInPandas(build, _BLOCK).checkpoint().coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def _block(rows: list[tuple], width: int) -> pd.DataFrame:
    sizes = np.array([len(r[0]) + 1 for r in rows])
    slot = np.concatenate([np.append(np.asarray(r[0], np.int64), width) for r in rows])
    value = np.concatenate([np.append(np.asarray(r[1], np.float64), 1.0) for r in rows])
    slots, number = np.unique(slot, return_inverse=True)
    order = np.argsort(number, kind="stable")
    owner = np.repeat(np.arange(len(rows)), sizes)
    parts = {
        "labels": np.array([np.asarray(r[2], bool) for r in rows]), "folds": np.array([r[3] for r in rows], np.int64),
        "by_row": number.astype(np.int64), "row_values": value, "row_starts": np.cumsum(sizes) - sizes, "slots": slots,
        "slot_starts": np.searchsorted(number[order], np.arange(len(slots))), "by_slot": owner[order].astype(np.int64),
        "slot_values": value[order],
    }
    return pd.DataFrame({k: [v.tobytes()] for k, v in parts.items()})


class Block:
    """A packed block's arrays: entries by row (number of the slot, value) and by slot (row, value).  Slots are numbered among the
    ``used`` ones."""

    def __init__(self, row, used: np.ndarray):
        read = lambda name, kind: np.frombuffer(getattr(row, name), kind)
        self.folds = read("folds", np.int64)
        self.slots = np.searchsorted(used, read("slots", np.int64))
        self.labels = read("labels", bool).reshape(len(self.folds), -1)
        self.by_row, self.row_values, self.row_starts = (
            read("by_row", np.int64), read("row_values", float), read("row_starts", np.int64))
        self.by_slot, self.slot_values, self.slot_starts = (
            read("by_slot", np.int64), read("slot_values", float), read("slot_starts", np.int64))

    def margins(self, coefficients: np.ndarray) -> np.ndarray:
        """[row, model] products with the rows of ``coefficients[slot, model]``."""
        part = np.ascontiguousarray(coefficients[self.slots].T)  # sums over neighbouring numbers, model by model
        return np.stack([np.add.reduceat(c[self.by_row] * self.row_values, self.row_starts) for c in part], axis=1)

    def by_slots(self, weights: np.ndarray, power: int = 1) -> np.ndarray:
        """[own slot, model] sums over the rows of their ``weights[row, model]`` times a power of the values."""
        values = self.slot_values ** power if power != 1 else self.slot_values
        part = np.ascontiguousarray(weights.T)
        return np.stack([np.add.reduceat(w[self.by_slot] * values, self.slot_starts) for w in part], axis=1)


def used_slots(blocks: DataFrame) -> np.ndarray:
    """The places that occur in any row, the intercept's last: at most as many numbers as there are places."""
    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for slots in batch["slots"]:
                seen = np.union1d(seen, np.frombuffer(slots, np.int64))
        yield pd.DataFrame({"slot": seen})

    rows = blocks.select("slots").mapInPandas(distinct, "slot long").distinct().toPandas()
    return np.sort(rows["slot"].to_numpy(np.int64))


# ---- one pass --------------------------------------------------------------------------------

def evaluate(blocks: DataFrame, used: np.ndarray, points: np.ndarray, label: np.ndarray, fold: np.ndarray,
             curvature: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(summed loss per model, summed gradient [coefficient, model]) at ``points[coefficient, model]``; with ``curvature`` the
    diagonal of the second derivatives in place of the gradient."""
    size, models = points.shape
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((used, points))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, at = sent.value
        total, loss, touched = np.zeros((size, models)), np.zeros(models), np.zeros(size, bool)
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row, places)
                margin, y = block.margins(at), block.labels[:, label]
                inside = block.folds[:, None] != fold
                loss += (np.logaddexp(0.0, np.where(y, -margin, margin)) * inside).sum(axis=0)
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
                own = block.by_slots(p * (1 - p) * inside, 2) if curvature else block.by_slots((p - y) * inside)
                total[block.slots] += own
                touched[block.slots] = True
        flat = total.ravel()
        pieces = np.unique(np.flatnonzero(touched)[:, None] * models // _PIECE)
        last = np.unique((np.flatnonzero(touched) * models + models - 1) // _PIECE)
        out = [(int(k), flat[k * _PIECE:(k + 1) * _PIECE].tobytes()) for k in np.union1d(pieces, last)]
        yield pd.DataFrame([*out, (-1, loss.tobytes())], columns=["piece", "sums"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, values in zip(batch["piece"], batch["sums"]):
                values = np.frombuffer(values)
                held[piece] = held[piece] + values if piece in held else values
        yield pd.DataFrame([(k, v.tobytes()) for k, v in held.items()], columns=["piece", "sums"])

    schema = "piece int, sums binary"
    rows = blocks.mapInPandas(sums, schema).repartition("piece").mapInPandas(add, schema).collect()
    sent.destroy()
    loss, flat = np.zeros(models), np.zeros(size * models)
    for r in rows:
        values = np.frombuffer(r["sums"])
        if r["piece"] < 0:
            loss = values
        else:
            flat[r["piece"] * _PIECE:r["piece"] * _PIECE + len(values)] = values
    return loss, flat.reshape(size, models)


# ---- one model's state ---------------------------------------------------------------------

@dataclass
class Search:
    """L-BFGS of one model in coordinates scaled by the fourth root of the curvature at the start (the square root suits the
    start, no scaling the end, where the penalty is what curves).  ``trial`` is the point whose loss and gradient
    it wants next.  It ends when no derivative exceeds ``tol``, when ``PATIENCE`` iterations have lowered the loss by no more
    than the share ``STALL``, or after the last of ``stops``.  ``at`` keeps the point after so many iterations, for models that
    differ in nothing else."""

    scale: np.ndarray
    tol: float
    stops: list[int]
    x: np.ndarray = None
    trial: np.ndarray = None
    at: dict[int, np.ndarray] = field(default_factory=dict)
    done: bool = False

    def __post_init__(self):
        self.x = np.zeros_like(self.scale)
        self.trial, self.f, self.g = self.x, None, None
        self.pairs: deque = deque(maxlen=HISTORY)
        self.past: deque = deque(maxlen=PATIENCE + 1)
        self.iterations, self.step = 0, 1.0

    def tell(self, f: float, g: np.ndarray) -> None:
        """Loss and gradient at ``trial``."""
        if self.f is not None:
            slope = float(self.g @ self.direction)
            if not f <= self.f + 1e-4 * self.step * slope:
                self.step *= 0.3
                if self.step < 1e-8:
                    self._finish()
                else:
                    self.trial = self.x + self.step * self.direction
                return
            s, y = (self.trial - self.x) / self.scale, (g - self.g) * self.scale
            if s @ y > 1e-12 * (y @ y):
                self.pairs.append((s, y, 1.0 / (s @ y)))
            self.iterations += 1
            self.x = self.trial
            if self.iterations in self.stops:
                self.at[self.iterations] = self.x
        self.f, self.g = f, g
        self.past.append(f)
        slow = len(self.past) > PATIENCE and self.past[0] - f <= STALL * abs(f)
        if slow or np.abs(g).max(initial=0.0) <= self.tol or self.iterations >= self.stops[-1]:
            self._finish()
            return
        q, used = g * self.scale, []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            q = q - a * y
            used.append(a)
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(self.pairs, reversed(used)):
            q = q + s * (a - r * (y @ q))
        self.direction, self.step = -q * self.scale, 1.0
        self.trial = self.x + self.direction

    def _finish(self) -> None:
        self.done = True
        for stop in self.stops:
            self.at.setdefault(stop, self.x)


def fit_all(blocks: DataFrame, width: int, specs: Sequence[Spec], rows: dict[int, int]) -> dict[Spec, LinearModel]:
    """Fit every model of ``specs`` on ``blocks``; ``rows`` says how many rows each fold has.

    The objective of a model is its mean loss plus the squared weights over 2 c n, as of n fitted rows.  Models that differ in
    ``max_iter`` only are one search.
    """
    total, used = sum(rows.values()), used_slots(blocks)
    searches: dict[tuple, list[Spec]] = {}
    for spec in specs:
        searches.setdefault((spec.label, spec.fold, spec.settings.c, spec.settings.tol), []).append(spec)
    keys = list(searches)
    group = max(1, PASS_COEFFICIENTS // len(used))
    found: dict[Spec, LinearModel] = {}
    for i in range(0, len(keys), group):
        for key, search in _fit_group(blocks, used, keys[i:i + group], searches, rows, total).items():
            for spec in searches[key]:
                found[spec] = LinearModel.of(width, used, search.at[spec.settings.max_iter])
    return found


def _fit_group(blocks: DataFrame, used: np.ndarray, keys: list[tuple], specs: dict[tuple, list[Spec]], rows: dict[int, int],
               total: int) -> dict[tuple, Search]:
    n = np.array([max(1, total - rows.get(k[1], 0)) for k in keys], float)
    penalty = 1.0 / (np.array([k[2] for k in keys]) * n)
    label, fold = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
    free = np.ones(len(used))
    free[-1] = 0.0
    start = np.zeros((len(used), len(keys)))
    _, curve = evaluate(blocks, used, start, label, fold, curvature=True)
    states = [
        Search(np.maximum(curve[:, k] / n[k] + penalty[k] * free, 1e-12) ** -0.25, key[3],
               sorted({s.settings.max_iter for s in specs[key]}))
        for k, key in enumerate(keys)
    ]
    active = list(range(len(keys)))
    while active:
        points = np.stack([states[k].trial for k in active], axis=1)
        loss, gradient = evaluate(blocks, used, points, label[active], fold[active])
        for j, k in enumerate(active):
            own = points[:, j] * free
            states[k].tell(loss[j] / n[k] + 0.5 * penalty[k] * float(own @ own), gradient[:, j] / n[k] + penalty[k] * own)
        active = [k for k in active if not states[k].done]
    return dict(zip(keys, states))


# ---- scoring ---------------------------------------------------------------------------------

def probabilities(models: Iterable[LinearModel], features: Column) -> Column:
    """array<double>: one probability per model, from the vector column ``features``."""
    models = list(models)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = np.stack([m.dense() for m in models], axis=1)
        for slots, values in batches:
            yield pd.Series([_sigmoid(weights, s, v) for s, v in zip(slots, values)], dtype=object)

    return score(*sparse_parts(features))


def fold_probabilities(models: dict[int, list[LinearModel]], features: Column, fold: Column) -> Column:
    """array<double>: one probability per model of the list that belongs to the row's fold."""
    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = {k: np.stack([m.dense() for m in ms], axis=1) for k, ms in models.items()}
        for slots, values, folds in batches:
            yield pd.Series([_sigmoid(weights[k], s, v) for s, v, k in zip(slots, values, folds)], dtype=object)

    return score(*sparse_parts(features), fold)


def _sigmoid(weights: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    margin = weights[-1] + np.asarray(values, float) @ weights[np.asarray(slots, np.int64)] if len(slots) else weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
