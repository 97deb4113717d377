"""A text encoder trained by the supervised contrastive loss.

An encoder is a vector for each of ``buckets`` hash buckets of words; a text is the unit-norm mean of its words' vectors.  Texts are
packed once into batches of sparse rows; a step sends the encoder to the tasks, each sums the gradients of the batches that it
reads, the sums are added piece by piece over one shuffle and the driver takes an Adam step along their mean.  So a step does not
depend on how the batches are spread over tasks.  The learning rate warms up; validation loss ends the training and picks the epoch.

What is broadcast, summed by a task and kept by the driver is the encoder, at most ``MAX_WEIGHTS`` numbers whatever the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.text import code_tokens
from labelmill.operators.embeddings import LOSS_BATCH, TEMPERATURE
from labelmill.session import ensure_checkpoint_dir

MAX_WEIGHTS = 1 << 23
BUCKETS, WIDTH = 1 << 14, 64
STEPS = 8                # steps of an epoch: each takes an equal share of the blocks
BLOCK_BATCHES = 16       # batches packed into one row of the block table
_PIECE = 1 << 13         # numbers of a gradient piece
_BLOCK = "step int, sizes binary, slots binary, counts binary, label_sizes binary, labels binary"
_STATE_PIECE = 1 << 16   # numbers of each array in one row of the saved state
_STATE = "epoch int, step int, best_epoch int, losses array<double>, pieces int, piece int, weights binary, best binary, " \
         "first binary, second binary"


@dataclass
class Encoder:
    """``weights[bucket, dimension]`` and the validation loss before training and after each epoch."""

    weights: np.ndarray
    losses: list[float] = field(default_factory=list)
    best_epoch: int = 0


def word_slots(text: Column, buckets: int) -> Column:
    """The bucket of each of the text's tokens; null text has none."""
    return F.coalesce(F.transform(code_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")),
                      F.array().cast("array<int>"))


# ---- batches ---------------------------------------------------------------------------------

def pack(rows: DataFrame, text: str, labels: str, buckets: int, tasks: int, steps: int, batch: int = LOSS_BATCH) -> DataFrame:
    """Blocks of batches of sparse rows.  Rows are dealt round robin to ``tasks`` tasks and cut into batches as they come, so
    copies of one text are spread; only a task's last batch is short.  Null labels are none."""
    names = F.coalesce(F.transform(F.array_distinct(labels), lambda x: F.xxhash64(x)), F.array().cast("array<long>"))
    dealt = rows.select(word_slots(F.col(text), buckets).alias("slots"), names.alias("labels")).repartition(tasks)
    size = batch * BLOCK_BATCHES

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = [], 0
        for part in parts:
            for slots, marks in zip(part["slots"], part["labels"]):
                held.append((*np.unique(np.asarray(slots, np.int32), return_counts=True), np.asarray(marks, np.int64)))
                if len(held) == size:
                    yield _block(held, number % steps)
                    held, number = [], number + 1
        if held:
            yield _block(held, number % steps)

    return dealt.mapInPandas(build, _BLOCK)


def _block(rows: list[tuple], step: int) -> pd.DataFrame:
    joined = lambda k, kind: np.concatenate([r[k] for r in rows]).astype(kind).tobytes()
    sizes = lambda k: np.array([len(r[k]) for r in rows], np.int32).tobytes()
    return pd.DataFrame([(step, sizes(0), joined(0, np.int32), joined(1, np.float32), sizes(2), joined(2, np.int64))],
                        columns=["step", "sizes", "slots", "counts", "label_sizes", "labels"])


def batches_of(block, batch: int = LOSS_BATCH) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """(rows of (slots, shares of the text), label hashes of the rows) of each batch of a block."""
    slots, counts = np.frombuffer(block.slots, np.int32), np.frombuffer(block.counts, np.float32)
    ends = np.cumsum(np.frombuffer(block.sizes, np.int32))[:-1]
    rows = [(s, c / max(c.sum(), 1.0)) for s, c in zip(np.split(slots, ends), np.split(counts, ends))]
    marks = np.split(np.frombuffer(block.labels, np.int64), np.cumsum(np.frombuffer(block.label_sizes, np.int32))[:-1])
    for at in range(0, len(rows), batch):
        yield rows[at:at + batch], marks[at:at + batch]


# ---- loss ------------------------------------------------------------------------------------

def loss_and_slope(vectors: np.ndarray, labels: Sequence[np.ndarray], temperature: float) -> tuple[float, np.ndarray]:
    """Supervised contrastive loss of a batch of vectors and its derivative by them; positives share a label."""
    n = len(vectors)
    names, place = np.unique(np.concatenate([*labels, np.empty(0, np.int64)]), return_inverse=True)
    hot = np.zeros((n, len(names)))
    hot[np.repeat(np.arange(n), [len(x) for x in labels]), place] = 1.0
    others = ~np.eye(n, dtype=bool)
    positive = (hot @ hot.T > 0) & others
    logits = vectors @ vectors.T / temperature
    logits -= logits.max(axis=1, keepdims=True)
    odds = np.exp(logits) * others
    total = odds.sum(axis=1, keepdims=True) + 1e-12
    share = positive / (positive.sum(axis=1, keepdims=True) + 1e-12)
    loss = -((logits - np.log(total)) * share).sum() / n
    pull = (share.sum(axis=1, keepdims=True) * odds / total - share) / n
    return float(loss), (pull + pull.T) @ vectors / temperature


def batch_gradient(rows: list[tuple], labels: Sequence[np.ndarray], weights: np.ndarray, temperature: float,
                   into: np.ndarray | None = None) -> float:
    """Loss of a batch; its gradient by the encoder's weights is added to ``into``.  A text without words is a zero vector."""
    means = np.array([share.astype(np.float64) @ weights[slots] for slots, share in rows])
    norms = np.sqrt((means * means).sum(axis=1, keepdims=True))
    unit = np.divide(means, norms, out=np.zeros_like(means), where=norms > 0)
    loss, slope = loss_and_slope(unit, labels, temperature)
    if into is not None:
        across = slope - unit * (unit * slope).sum(axis=1, keepdims=True)
        across = np.divide(across, norms, out=np.zeros_like(across), where=norms > 0)
        for (slots, share), d in zip(rows, across):
            into[slots] += share[:, None] * d  # a row's slots are distinct
    return loss


def evaluate(blocks: DataFrame, weights: np.ndarray, temperature: float = TEMPERATURE, batch: int = LOSS_BATCH,
             slope: bool = True) -> tuple[int, float, np.ndarray]:
    """(batches, mean loss, mean gradient) over all blocks at ``weights``; the gradient stays zero without ``slope``."""
    sent = blocks.sparkSession.sparkContext.broadcast(weights)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = sent.value
        total, head = (np.zeros(at.shape) if slope else None), np.zeros(2)
        for part in parts:
            for block in part.itertuples(index=False):
                for rows, labels in batches_of(block, batch):
                    head += 1, batch_gradient(rows, labels, at, temperature, total)
        flat = total.ravel() if slope else np.empty(0)
        cut = [(k, flat[k * _PIECE:(k + 1) * _PIECE]) for k in range(-(-len(flat) // _PIECE))]
        yield pd.DataFrame([*((k, x.tobytes()) for k, x in cut if x.any()), (-1, head.tobytes())], columns=["piece", "sums"])

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            for piece, values in zip(part["piece"], part["sums"]):
                values = np.frombuffer(values)
                held[piece] = held[piece] + values if piece in held else values
        yield pd.DataFrame([(k, v.tobytes()) for k, v in held.items()], columns=["piece", "sums"])

    schema = "piece int, sums binary"
    found = blocks.mapInPandas(sums, schema).repartition("piece").mapInPandas(add, schema).collect()
    sent.destroy()
    head, flat = np.zeros(2), np.zeros(weights.size)
    for r in found:
        values = np.frombuffer(r["sums"])
        if r["piece"] < 0:
            head = values
        else:
            flat[r["piece"] * _PIECE:r["piece"] * _PIECE + len(values)] = values
    n = max(head[0], 1.0)
    return int(head[0]), float(head[1] / n), flat.reshape(weights.shape) / n


# ---- training --------------------------------------------------------------------------------

@dataclass
class _State:
    """Adam's moments, the weights, and the best epoch so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    step: int = 0
    best_epoch: int = 0
    losses: list[float] = field(default_factory=list)

    def move(self, slope: np.ndarray, rate: float, decay: float) -> None:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope * slope
        step = self.first / (1 - 0.9 ** self.step) / (np.sqrt(self.second / (1 - 0.999 ** self.step)) + 1e-8)
        self.weights = self.weights - rate * (step + decay * self.weights)

    def judge(self, loss: float) -> None:
        """Note the validation loss of the epoch that has just ended (0: before training)."""
        if not self.losses or loss < min(self.losses):
            self.best, self.best_epoch = self.weights, len(self.losses)
        self.losses.append(loss)

    def save(self, spark: SparkSession, folder: str) -> None:
        arrays = [x.ravel() for x in (self.weights, self.best, self.first, self.second)]
        pieces = -(-self.weights.size // _STATE_PIECE)
        head = (len(self.losses) - 1, self.step, self.best_epoch, self.losses, pieces)
        rows = [(*head, k, *(bytearray(x[k * _STATE_PIECE:(k + 1) * _STATE_PIECE].tobytes()) for x in arrays))
                for k in range(pieces)]
        spark.createDataFrame(rows, _STATE).write.mode("append").parquet(f"{folder}/state")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, shape: tuple[int, int]) -> _State | None:
        """The last epoch that is saved whole; None if there is none."""
        try:
            saved = spark.read.schema(_STATE).parquet(f"{folder}/state")
        except AnalysisException:
            return None
        whole = saved.groupBy("epoch").agg(F.count_distinct("piece").alias("n"), F.max("pieces").alias("pieces")).where("n = pieces")
        last = whole.agg(F.max("epoch")).head()[0]
        if last is None:
            return None
        rows = sorted(saved.where(F.col("epoch") == last).collect(), key=lambda r: r["piece"])
        weights, best, first, second = (
            np.concatenate([np.frombuffer(r[k]) for r in rows]).reshape(shape) for k in ("weights", "best", "first", "second"))
        return cls(weights, first, second, best, rows[0]["step"], rows[0]["best_epoch"], list(rows[0]["losses"]))


def fit_encoder(train: DataFrame, val: DataFrame | None, text: str, labels: str, buckets: int = BUCKETS, width: int = WIDTH,
                epochs: int = 10, steps: int = STEPS, rate: float = 0.02, warmup: float = 0.1, decay: float = 0.01,
                patience: int = 2, temperature: float = TEMPERATURE, batch: int = LOSS_BATCH, seed: int = 42,
                folder: str | None = None) -> Encoder:
    """Train on texts and their label lists; the weights of the epoch with the least loss on ``val`` are returned.

    The learning rate rises over the share ``warmup`` of all steps to ``rate``.  Training ends after ``patience`` epochs
    without a smaller loss.  Without validation rows the loss on ``train`` counts.  An empty ``train`` gives the starting weights.
    Blocks and the state after each epoch are tables in ``folder`` (a new one in spark.checkpoint.dir if None); a call with the
    folder of an interrupted training goes on after its last epoch.
    """
    if buckets * width > MAX_WEIGHTS:
        raise ValueError(f"an encoder has at most {MAX_WEIGHTS} weights: every task holds it")
    spark = train.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/contrastive-{uuid.uuid4().hex}"
    tasks = spark.sparkContext.defaultParallelism
    made = {}
    for part, rows in (("train", train), ("val", val)):
        if rows is not None:
            path = f"{folder}/{part}-{uuid.uuid4().hex}"
            pack(rows, text, labels, buckets, tasks, steps, batch).write.partitionBy("step").parquet(path)
            made[part] = spark.read.schema(_BLOCK).parquet(path)
    judged = made["val"] if "val" in made and not made["val"].isEmpty() else made["train"]
    state = _State.load(spark, folder, (buckets, width))
    if state is None:
        start = np.random.default_rng(seed).standard_normal((buckets, width)) / np.sqrt(width)
        state = _State(start, np.zeros_like(start), np.zeros_like(start), start)
        state.judge(evaluate(judged, start, temperature, batch, slope=False)[1])
    rising = max(1.0, warmup * epochs * steps)
    while len(state.losses) <= epochs and len(state.losses) - 1 - state.best_epoch < patience:
        for step in range(steps):
            n, _, slope = evaluate(made["train"].where(F.col("step") == step), state.weights, temperature, batch)
            if n:
                state.move(slope, rate * min(1.0, (state.step + 1) / rising), decay)
        state.judge(evaluate(judged, state.weights, temperature, batch, slope=False)[1])
        state.save(spark, folder)
    return Encoder(state.best, state.losses, state.best_epoch)


def embed_with_encoder(df: DataFrame, text: str, encoder: Encoder, output: str = "embedding") -> DataFrame:
    """``df`` with the unit-norm mean of the whole text's word vectors; zeros for a text without words."""
    buckets, width = encoder.weights.shape
    sent = df.sparkSession.sparkContext.broadcast(encoder.weights.astype(np.float32))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = sent.value
        for part in parts:
            out = []
            for slots in part:
                places, counts = np.unique(slots, return_counts=True)
                total = counts.astype(np.float32) @ weights[places.astype(np.int32)] if len(places) else np.zeros(width)
                out.append((total / max(np.sqrt((total * total).sum()), 1e-30)).astype(np.float32))
            yield pd.Series(out)

    return df.withColumn(output, run(word_slots(F.col(text), buckets)))
