"""Random forests of open depth, grown and scored without a whole tree in the driver or in a task.

Such a tree has nodes in proportion to its rows, so a forest of them outgrows one machine.  Rows are binned once and packed into
blocks.  The top of every tree is grown on the blocks: a pass sums histograms of the nodes that have too many rows for a
task, ``PASS_NODES`` at most, and the driver gets their best splits.  The rows of every node with ``TASK_ROWS`` rows or fewer are then
sent to one task, which grows the rest of that branch.  A branch with the path that leads to it is a row of the model; rows are
scored by meeting all branches.  The driver holds the tops, one node per ``TASK_ROWS`` rows and tree or so.

Trees are those of Spark ML: Gini impurity, rows drawn with replacement (Poisson), a square root of the columns tried per node, a
leaf where none of them helps, sister leaves that answer alike are merged.  Cuts come from all rows, not from a sample.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.operators.logistic import sparse_parts
from labelmill.session import ensure_checkpoint_dir, materialise

BINS = 32
TASK_ROWS = 1 << 16     # drawn rows of a branch that a task grows
PASS_NODES = 1 << 12    # nodes of a pass over the blocks: 34 MB of histograms at 1,024 columns
PASS_PIECE = 1 << 5     # nodes whose histograms travel together
CHUNK_CELLS = 1 << 18   # histogram cells that a task holds at a time while it grows a branch
BLOCK_BYTES = 1 << 21   # binned rows of a block
SENT_ROWS, SENT_TREES = 1 << 21, 32  # rows sent to branches at a time, but at least so many trees' rows
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the query that made them
BUNDLE_BYTES = 1 << 22  # branches that meet a block together
ONE = 1 << 30           # a leaf's probability is a whole number of parts, so sums do not depend on their order
_BLOCK = "block long, bins binary, labels binary, ids binary"
_SENT = "key long, drawn binary, labels binary, places binary, bins binary"
_BRANCH = "label int, tree int, key long, path binary, nodes int, count_0 double, count_1 double, " \
          "columns binary, cuts binary, children binary, parts binary"


@dataclass(frozen=True)
class DeepForest:
    """Settings of a forest.  A split leaves ``least`` drawn rows on each side; ``balanced`` weighs both classes alike."""

    trees: int
    depth: int
    least: int = 1
    balanced: bool = False
    seed: int = 42


@dataclass
class Forest:
    """Forests of several labels: the branches, and the cuts that bin a row."""

    width: int
    cuts: list[tuple[int, float]]
    branches: DataFrame

    def save(self, path: str) -> None:
        spark = self.branches.sparkSession
        self.branches.write.mode("overwrite").parquet(f"{path}/branches")
        rows = [(self.width, [s for s, _ in self.cuts], [c for _, c in self.cuts])]
        spark.createDataFrame(rows, "width int, slots array<int>, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/cuts")

    @classmethod
    def load(cls, path: str, spark) -> Forest:
        r = spark.read.parquet(f"{path}/cuts").head()
        return cls(r["width"], list(zip(r["slots"], r["cuts"])), spark.read.parquet(f"{path}/branches"))


@dataclass(frozen=True)
class ForestModel:
    """One label's trees in a forest."""

    forest: Forest
    label: int


# ---- rows ------------------------------------------------------------------------------------

def fit_cuts(rows: DataFrame, n: int) -> list[tuple[int, float]]:
    """(column, cut) in order, of ``rows(slots, values)``: between any two values of a column that has ``BINS`` values at most, else
    where the rank passes a multiple of n / ``BINS``.  Absent values are zeros."""
    entry = F.explode(F.arrays_zip("slots", "values"))
    counts = rows.select(entry.alias("e")).select(F.col("e.slots").alias("slot"), F.col("e.values").alias("value")).where(
        "value <> 0").groupBy("slot", "value").agg(F.count("*").alias("n"))
    zeros = counts.groupBy("slot").agg((F.lit(n) - F.sum("n")).alias("n")).where("n > 0").select("slot", F.lit(0.0).alias("value"), "n")
    by_value = Window.partitionBy("slot").orderBy("value")
    before = F.coalesce(F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.unionByName(zeros).select(
        "slot", "value", F.lag("value").over(by_value).alias("last"), before.alias("before"),
        F.coalesce(F.lag("n").over(by_value), F.lit(0)).alias("step"), F.count("*").over(Window.partitionBy("slot")).alias("different"))
    part = lambda rank: F.floor(rank * BINS / n)
    passed = part(F.col("before")) > part(F.col("before") - F.col("step"))
    kept = ranked.where(F.col("last").isNotNull() & ((F.col("different") <= BINS) | passed))
    found = kept.select("slot", ((F.col("last") + F.col("value")) / 2).alias("cut")).collect()
    return sorted((r["slot"], r["cut"]) for r in found)


def pack(rows: DataFrame, cuts: Sequence[tuple[int, float]], width: int) -> DataFrame:
    """Blocks of ``rows(slots, values, labels array<boolean>, id)`` as a table in the shared checkpoint folder; a row has one byte per column."""
    slots = np.array([s for s, _ in cuts], np.int64)
    at, starts = np.array([c for _, c in cuts], float), np.searchsorted(slots, np.arange(width + 1))
    sent = rows.sparkSession.sparkContext.broadcast((at, starts, _bins(at, starts, np.arange(width), np.zeros(width))))
    size = max(1, BLOCK_BYTES // width)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, starts, zero = sent.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                slot, values = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                lengths = part.column(0).value_lengths().to_numpy(zero_copy_only=False)
                binned = np.tile(zero, (part.num_rows, 1))
                binned[np.repeat(np.arange(part.num_rows), lengths), slot] = _bins(at, starts, slot, values)
                labels = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(bool)
                ids = part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                yield _batch(_BLOCK, [(number, binned.tobytes(), labels.tobytes(), ids.tobytes())])
                number += 1

    return _stored(rows.select("slots", "values", "labels", "id").mapInArrow(build, _BLOCK))


def _bins(at: np.ndarray, starts: np.ndarray, slot: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many cuts of its column are below each value: all entries are bisected together."""
    low, high = starts[slot], starts[slot + 1]
    first = low
    while (open_ := low < high).any():
        middle = (low + high) // 2
        above = open_ & (at[np.minimum(middle, len(at) - 1)] < values)
        low, high = np.where(above, middle + 1, low), np.where(open_ & ~above, middle, high)
    return (low - first).astype(np.uint8)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def _stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, which its owner clears."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/forest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drawn(setting: DeepForest, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return np.random.default_rng((setting.seed, tree, block)).poisson(1.0, n).astype(np.uint8)


# ---- splits ----------------------------------------------------------------------------------

def draw_columns(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """[node, column]: a square root of the columns, different ones, for each node."""
    tried = int(np.ceil(np.sqrt(width)))
    if tried >= width:
        return np.tile(np.arange(width), (nodes, 1))
    out = rng.integers(0, width, (nodes, tried))
    again = np.arange(nodes)
    while len(again):
        ordered = np.sort(out[again], axis=1)
        again = again[(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)]
        out[again] = rng.integers(0, width, (len(again), tried))
    return out


def histogram(binned: np.ndarray, rows: np.ndarray, node: np.ndarray, columns: np.ndarray, y: np.ndarray,
              drawn: np.ndarray) -> np.ndarray:
    """[class, node, column, bin] drawn rows of some ``rows``, whose ``node`` tries ``columns[node]``."""
    nodes, tried = columns.shape
    cell = binned.ravel().take(rows[:, None] * binned.shape[1] + columns[node]).astype(np.int64)
    cell += ((y[rows] * nodes + node) * (tried * BINS))[:, None] + np.arange(0, tried * BINS, BINS)
    counts = np.bincount(cell.ravel(), weights=np.repeat(drawn[rows].astype(float), tried), minlength=2 * nodes * tried * BINS)
    return counts.reshape(2, nodes, tried, BINS)


def best_splits(counts: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node (number of the column or -1, last bin of the left side, drawn rows of the left side by class) of the largest decrease
    of impurity, the first of equal ones.  ``weights[class, node]`` weigh the rows."""
    nodes = counts.shape[1]
    left = counts.cumsum(axis=3)
    total = left[:, :, 0, -1].copy()
    left = left[..., :-1]

    def purity(rows: np.ndarray) -> np.ndarray:
        a, b = rows * weights.reshape(weights.shape + (1,) * (rows.ndim - 2))
        both = a + b
        a *= a
        b *= b
        a += b
        return np.divide(a, both, out=a, where=both > 0)

    right = total[:, :, None, None] - left
    pure = purity(left)
    pure += purity(right)
    pure[(left[0] + left[1] < least) | (right[0] + right[1] < least)] = 0.0
    flat = pure.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    some = np.arange(nodes)
    gain = flat[some, best] - purity(total)
    column, cut = best // (BINS - 1), best % (BINS - 1)
    return np.where(gain > 1e-12 * (total * weights).sum(axis=0), column, -1), cut, left[:, some, column, cut].T


def merge_leaves(children: np.ndarray, counts: np.ndarray, levels: Sequence[np.ndarray]) -> np.ndarray:
    """``children`` (the first of two, -1 at a leaf) after sister leaves with the same likelier class became one leaf, from below."""
    children = children.copy()
    answer = counts[:, 1] > counts[:, 0]
    for ids in reversed(levels):
        inner = ids[children[ids] >= 0]
        a, b = children[inner], children[inner] + 1
        children[inner[(children[a] < 0) & (children[b] < 0) & (answer[a] == answer[b])]] = -1
    return children


# ---- a branch --------------------------------------------------------------------------------

def grow(binned: np.ndarray, y: np.ndarray, drawn: np.ndarray, weights: np.ndarray, depth: int, least: int,
         rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, cut, children, counts) per node, level after level: a row goes to the second child when its bin is above the cut."""
    width = binned.shape[1]
    at_once = max(1, CHUNK_CELLS // (int(np.ceil(np.sqrt(width))) * BINS * 2))
    column, cut, children = [np.full(1, -1)], [np.zeros(1, np.int64)], [np.full(1, -1)]
    counts = [np.bincount(y, weights=drawn, minlength=2)[None]]
    levels, first, rows, node = [np.zeros(1, np.int64)], 0, np.arange(len(y)), np.zeros(len(y), np.int64)
    for level in range(depth):
        own = counts[-1]
        mixed = np.flatnonzero((own > 0).all(axis=1) & (own.sum(axis=1) >= 2 * least))
        if not len(mixed):
            break
        number = np.full(len(own), -1)
        number[mixed] = np.arange(len(mixed))
        kept = number[node] >= 0
        rows, node = rows[kept], number[node[kept]]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        ends = np.searchsorted(node, np.arange(len(mixed) + 1))
        next_counts, next_rows, next_node, born = [], [], [], 0
        for i in range(0, len(mixed), at_once):
            j = min(i + at_once, len(mixed))
            r, a = rows[ends[i]:ends[j]], node[ends[i]:ends[j]] - i
            tried = draw_columns(rng, j - i, width)
            which, at, left = best_splits(histogram(binned, r, a, tried, y, drawn), np.tile(weights[:, None], j - i), least)
            split = np.flatnonzero(which >= 0)
            ids = first + mixed[i:j][split]
            taken = tried[split, which[split]]
            column[-1][ids - first], cut[-1][ids - first] = taken, at[split]
            children[-1][ids - first] = first + len(own) + born + 2 * np.arange(len(split))
            next_counts.append(np.stack([left[split], counts[-1][ids - first] - left[split]], axis=1).reshape(-1, 2))
            place = np.full(j - i, -1)
            place[split] = np.arange(len(split))
            inside = place[a] >= 0
            r, a = r[inside], place[a[inside]]
            above = binned[r, taken[a]] > at[split][a]
            next_rows.append(r)
            next_node.append(born + 2 * a + above)
            born += 2 * len(split)
        if not born:
            break
        first += len(own)
        rows, node = np.concatenate(next_rows), np.concatenate(next_node)
        counts.append(np.concatenate(next_counts))
        column.append(np.full(born, -1))
        cut.append(np.zeros(born, np.int64))
        children.append(np.full(born, -1))
        levels.append(first + np.arange(born))
    column, cut, children, counts = (np.concatenate(x) for x in (column, cut, children, counts))
    children = merge_leaves(children, counts * weights, levels)
    reached = np.zeros(len(children), bool)
    reached[0] = True
    for ids in levels:
        inner = ids[reached[ids] & (children[ids] >= 0)]
        reached[children[inner]] = reached[children[inner] + 1] = True
    renumbered = np.cumsum(reached) - 1
    children = np.where(children >= 0, renumbered[children], -1)
    return column[reached], cut[reached], children[reached], counts[reached]


def walk(binned: np.ndarray, column: np.ndarray, cut: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    at = np.zeros(len(binned), np.int64)
    going = np.arange(len(binned)) if children[0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        node = at[going]
        at[going] = children[node] + (binned[going, column[node]] > cut[node])
        going = going[children[at[going]] >= 0]
    return at


# ---- the tops --------------------------------------------------------------------------------

class Top:
    """The nodes of a tree that are split on the blocks: small, held by the driver.  ``state`` is open, ready (a task grows it) or
    done."""

    def __init__(self, state: str):
        self.column, self.cut, self.children, self.counts, self.depth = [-1], [0], [-1], [(0.0, 0.0)], [0]
        self.state, self.paths = [state], [()]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.column, self.cut, self.children))

    def split(self, node: int, column: int, cut: int, left: np.ndarray, right: np.ndarray, depth: int, least: int) -> None:
        self.column[node], self.cut[node], self.children[node] = column, cut, len(self.column)
        for side, counts in enumerate((left, right)):
            final = min(counts) <= 0 or sum(counts) < 2 * least or self.depth[node] + 1 >= depth
            self.column.append(-1)
            self.cut.append(0)
            self.children.append(-1)
            self.counts.append(tuple(counts))
            self.depth.append(self.depth[node] + 1)
            self.paths.append(self.paths[node] + ((column, cut, side),))
            self.state.append("done" if final else "ready" if sum(counts) <= TASK_ROWS else "open")
        self.state[node] = "done"


def _grow_tops(blocks: DataFrame, width: int, labels: int, tops: list[Top], setting: DeepForest, weights: np.ndarray) -> None:
    """Split the nodes of more than ``TASK_ROWS`` drawn rows.  Tree t of label l is number t * labels + l."""
    spark, turn = blocks.sparkSession, 0
    while nodes := [(k, i) for k, top in enumerate(tops) for i, s in enumerate(top.state) if s == "open"][:PASS_NODES]:
        turn += 1
        columns = draw_columns(np.random.default_rng((setting.seed, 1 << 20, turn)), len(nodes), width)
        wanted: dict[int, dict[int, int]] = {}
        for number, (k, i) in enumerate(nodes):
            wanted.setdefault(k, {})[i] = number
        sent = spark.sparkContext.broadcast((
            {k: (tops[k].arrays(), wanted[k]) for k in wanted}, columns, weights[[k % labels for k, _ in nodes]]))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, columns, _ = sent.value
            total = np.zeros((len(columns), 2, columns.shape[1], BINS), np.int32)
            for block, binned, y, _ in _blocks(batches, width, labels):
                for k, (arrays, numbers) in trees.items():
                    drawn = _drawn(setting, k // labels, block, len(binned))
                    place = np.full(len(arrays[0]), -1)
                    place[list(numbers)] = np.arange(len(numbers))
                    own = list(numbers.values())
                    a = place[walk(binned, *arrays)]
                    r = np.flatnonzero((a >= 0) & (drawn > 0))
                    counts = histogram(binned, r, a[r], columns[own], y[:, k % labels].astype(np.int64), drawn)
                    total[own] += counts.swapaxes(0, 1).astype(np.int32)
            for i in range(0, len(total), PASS_PIECE):
                yield _batch("piece int, counts binary", [(i // PASS_PIECE, total[i:i + PASS_PIECE].tobytes())])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, columns, weights = sent.value
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                    counts = np.frombuffer(counts.as_buffer(), np.int32)
                    held[piece] = held[piece] + counts if piece in held else counts
            for piece, counts in held.items():
                i = piece * PASS_PIECE
                own = weights[i:i + PASS_PIECE]
                counts = counts.reshape(len(own), 2, columns.shape[1], BINS).swapaxes(0, 1).astype(float)
                which, cut, left = best_splits(counts, own.T, setting.least)
                total = counts[:, :, 0].sum(axis=2).T
                rows = [(i + j, int(columns[i + j, w]) if w >= 0 else -1, int(c), *map(float, (*a, *t)))
                        for j, (w, c, a, t) in enumerate(zip(which, cut, left, total))]
                yield _batch("node int, column int, cut int, a double, b double, c double, d double", rows)

        counted = blocks.mapInArrow(sums, "piece int, counts binary").repartition("piece")
        found = counted.mapInArrow(best, "node int, column int, cut int, a double, b double, c double, d double").collect()
        sent.destroy()
        for number, column, cut, a, b, c, d in found:
            k, i = nodes[number]
            top = tops[k]
            top.counts[i] = (c, d)
            if column < 0:
                top.state[i] = "done"
            else:
                top.split(i, column, cut, np.array((a, b)), np.array((c - a, d - b)), setting.depth, setting.least)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, labels: int) -> Iterator[tuple]:
    for batch in batches:
        for block, binned, y, ids in zip(batch.column(0).to_pylist(), *(batch.column(c) for c in (1, 2, 3))):
            binned = np.frombuffer(binned.as_buffer(), np.uint8).reshape(-1, width)
            y = np.frombuffer(y.as_buffer(), bool).reshape(len(binned), -1) if labels else None
            yield block, binned, y, np.frombuffer(ids.as_buffer(), np.int64)


def _path(path: tuple) -> bytes:
    return np.array(path, np.int32).tobytes()


# ---- fit -------------------------------------------------------------------------------------

def fit_forests(train: DataFrame, truth: Sequence[Column], setting: DeepForest, n: int, positives: Sequence[int]) -> list[ForestModel]:
    """One forest per column of ``truth`` on the ``n`` rows of ``train(features)``; both classes occur in each."""
    spark, labels = train.sparkSession, len(truth)
    if not labels:
        return []
    slots, values = sparse_parts(F.col("features"))
    rows = train.select(slots.alias("slots"), values.alias("values"), F.array(*truth).alias("labels"), F.lit(0).cast("long").alias("id"),
                        F.coalesce(F.unwrap_udt("features")["size"], F.size(F.unwrap_udt("features")["values"])).alias("size"))
    width = rows.agg(F.max("size")).head()[0]
    cuts = fit_cuts(rows, n)
    blocks = pack(rows, cuts, width)
    kept = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        branches = _fit(blocks, width, labels, setting, n, positives)
    finally:
        spark.conf.set(FREED, kept)
    forest = Forest(width, cuts, branches)
    return [ForestModel(forest, label) for label in range(labels)]


def _fit(blocks: DataFrame, width: int, labels: int, setting: DeepForest, n: int, positives: Sequence[int]) -> DataFrame:
    spark = blocks.sparkSession
    weights = np.array([(n / (2.0 * (n - p)), n / (2.0 * p)) if setting.balanced else (1.0, 1.0) for p in positives])
    tops = [Top("ready" if n <= TASK_ROWS else "open") for _ in range(setting.trees * labels)]
    _grow_tops(blocks, width, labels, tops, setting, weights)
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    at_once = max(SENT_TREES, SENT_ROWS // n)
    for i in range(0, len(tops), at_once):
        _grow_branches(blocks, width, labels, tops, range(i, min(i + at_once, len(tops))), setting, weights).write.mode(
            "append").parquet(path)
    return _with_tops(spark.read.schema(_BRANCH).parquet(path), tops, labels, weights)


def _grow_branches(blocks: DataFrame, width: int, labels: int, tops: list[Top], numbers: range, setting: DeepForest,
                   weights: np.ndarray) -> DataFrame:
    """The branches of some trees.  A row travels as the places of its bins above 0 and those bins."""
    spark = blocks.sparkSession
    ready = {k: {i: (top.paths[i], top.depth[i]) for i, s in enumerate(top.state) if s == "ready"} for k, top in (
        (k, tops[k]) for k in numbers)}
    sent = spark.sparkContext.broadcast({k: (tops[k].arrays(), nodes) for k, nodes in ready.items() if nodes})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, binned, y, _ in _blocks(batches, width, labels):
            above = binned > 0
            places, sizes, bins = np.packbits(above, axis=1), above.sum(axis=1), binned[above]
            ends = np.cumsum(sizes)
            for k, (arrays, nodes) in sent.value.items():
                drawn = _drawn(setting, k // labels, block, len(binned))
                wanted = np.zeros(len(arrays[0]), bool)
                wanted[list(nodes)] = True
                node = walk(binned, *arrays)
                r = np.flatnonzero(wanted[node] & (drawn > 0))
                r = r[np.argsort(node[r], kind="stable")]
                out = []
                for part in np.split(r, np.flatnonzero(np.diff(node[r])) + 1):
                    if len(part):
                        entries = np.repeat(ends[part] - np.cumsum(sizes[part]), sizes[part]) + np.arange(sizes[part].sum())
                        out.append((k << 32 | int(node[part[0]]), drawn[part].tobytes(), y[part, k % labels].tobytes(),
                                    places[part].tobytes(), bins[entries].tobytes()))
                if out:
                    yield _batch(_SENT, out)

    def branch(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        joined = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8)
        drawn, y, places = joined("drawn"), joined("labels"), joined("places").reshape(-1, (width + 7) // 8)
        above = np.unpackbits(places, axis=1, count=width).view(bool)
        binned = np.zeros(above.shape, np.uint8)
        binned[above] = joined("bins")
        k, node = key >> 32, key & 0xFFFFFFFF
        path, depth = sent.value[k][1][node]
        own = weights[k % labels]
        column, cut, children, counts = grow(binned, y.astype(np.int64), drawn, own, setting.depth - depth, setting.least,
                                             np.random.default_rng((setting.seed, k, node)))
        return pa.Table.from_batches([_batch(_BRANCH, [_branch(k, labels, key, path, column, cut, children, counts, own)])])

    parts = 4 * spark.sparkContext.defaultParallelism
    return blocks.mapInArrow(send, _SENT).repartition(parts, "key").groupBy("key").applyInArrow(branch, _BRANCH)


def _branch(k: int, labels: int, key: int, path: tuple, column, cut, children, counts, weights: np.ndarray) -> tuple:
    weighted = np.asarray(counts) * weights
    parts = np.rint(weighted[:, 1] / np.maximum(weighted.sum(axis=1), 1e-300) * ONE).astype(np.int32)
    return (k % labels, k // labels, key, _path(path), len(column), float(counts[0][0]), float(counts[0][1]),
            np.asarray(column, np.int32).tobytes(), np.asarray(cut, np.uint8).tobytes(), np.asarray(children, np.int32).tobytes(),
            parts.tobytes())


def _with_tops(branches: DataFrame, tops: list[Top], labels: int, weights: np.ndarray) -> DataFrame:
    """The branches with the leaves of the tops; sister leaves that answer alike are merged here too."""
    if all(len(t.column) == 1 and t.state[0] == "ready" for t in tops):
        return branches
    single = {r["key"]: (r["count_0"], r["count_1"]) for r in branches.where("nodes = 1").select("key", "count_0", "count_1").collect()}
    gone, leaves = [], []
    for k, top in enumerate(tops):
        counts = np.array(top.counts)
        is_leaf = [top.children[i] < 0 and (s == "done" or k << 32 | i in single) for i, s in enumerate(top.state)]
        children, own = np.array(top.children), weights[k % labels]
        answer = (counts * own)[:, 1] > (counts * own)[:, 0]
        for i in reversed(range(len(children))):
            a = children[i]
            if a >= 0 and is_leaf[a] and is_leaf[a + 1] and answer[a] == answer[a + 1]:
                is_leaf[i], children[i] = True, -1
        reached = [0]
        for i in reached:
            if children[i] >= 0:
                reached += [children[i], children[i] + 1]
        for i in range(len(children)):
            key = k << 32 | i
            if top.state[i] == "ready" and i not in reached:
                gone.append((key,))
            elif i in reached and children[i] < 0 and top.state[i] == "done":
                leaves.append(_branch(k, labels, key, top.paths[i], [-1], [0], [-1], [top.counts[i]], own))
    spark = branches.sparkSession
    if gone:
        branches = branches.join(F.broadcast(spark.createDataFrame(gone, "key long")), "key", "left_anti").select(*branches.columns)
    return branches.unionByName(spark.createDataFrame(leaves, _BRANCH)) if leaves else branches


# ---- scoring ---------------------------------------------------------------------------------

def score(df: DataFrame, forest: Forest, labels: Sequence[int], output: str) -> DataFrame:
    """Add array<double> with the probabilities of some of the forest's labels: blocks of rows meet bundles of branches, and a row's sums
    come back to it by its number."""
    held = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    slots, values = sparse_parts(F.col("features"))
    none = F.array().cast("array<boolean>")
    blocks = pack(held.select(slots.alias("slots"), values.alias("values"), none.alias("labels"), F.col("_row").alias("id")),
                  forest.cuts, forest.width)
    width, places = forest.width, {label: i for i, label in enumerate(labels)}

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                some.append(row)
                size += 13 * row.column(2)[0].as_py()
                if size >= BUNDLE_BYTES:
                    yield _bundled(some)
                    some, size = [], 0
        if some:
            yield _bundled(some)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, binned, _, ids = next(_blocks(iter([batch.slice(row, 1)]), width, 0))
                sums = np.zeros((len(binned), len(places), 2), np.int64)
                for branches in pa.ipc.open_stream(batch.column(4)[row].as_buffer()):
                    for label, path, _, *arrays in zip(*(branches.column(c) for c in range(7))):
                        column, cut, children, parts = (
                            np.frombuffer(x.as_buffer(), kind) for x, kind in zip(arrays, (np.int32, np.uint8, np.int32, np.int32)))
                        rows = np.arange(len(binned))
                        for at, limit, side in np.frombuffer(path.as_buffer(), np.int32).reshape(-1, 3):
                            rows = rows[(binned[rows, at] > limit) == side]
                        if len(rows):
                            sums[rows, places[label.as_py()], 0] += parts[walk(binned[rows], column, cut, children)]
                            sums[rows, places[label.as_py()], 1] += 1
                yield _batch("block long, ids binary, sums binary", [(block, ids.tobytes(), sums.tobytes())])

    def add(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table.column("ids")[0].as_buffer(), np.int64)
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums")).reshape(-1, 2)
        mean = total[:, 0] / ONE / np.maximum(total[:, 1], 1)  # a tree that drew no row has no say
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(places)), pa.array(mean))
        return pa.table({"_row": ids, output: flat})

    wanted = forest.branches.where(F.col("label").isin(list(labels))).select("label", "path", "nodes", "columns", "cuts", "children", "parts")
    bundles = _stored(wanted.mapInArrow(bundle, "bundle binary"))
    # Neither side is sent through the driver, whatever Spark takes its size for.
    sums = blocks.hint("shuffle_replicate_nl").crossJoin(bundles).mapInArrow(meet, "block long, ids binary, sums binary")
    found = sums.groupBy("block").applyInArrow(add, f"_row long, {output} array<double>")
    return held.join(found, "_row").drop("_row")


def _bundled(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows[0].schema) as stream:
        stream.write_batch(pa.Table.from_batches(rows).combine_chunks().to_batches()[0])
    return _batch("bundle binary", [(out.getvalue().to_pybytes(),)])
