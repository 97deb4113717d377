"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length 1.  A coarse codebook deals them into inverted lists, and what the list's centroid leaves
over is coded subspace by subspace.  A query probes its own list and every list whose boundary is near enough for
a partner to lie beyond it; in a list, table lookups give the distance to each coded vector, which with the
vector's known coding error bounds the true distance; what may be near enough is compared exactly.

With the least distance r of a link (cosine c: r^2 = 2 - 2c), two linked vectors in different cells have depths behind the
boundary between the cells that add up to r at most, so one of them is within r / 2 of it.  A query probes every list whose
boundary is no farther than that, and a pair is compared where either vector probes the other's list: nothing is lost.
Where both do, it counts in the list with the larger number.  ``slack`` scales the margin (0.5: r / 2; less may lose
links).  The lookup bound itself loses nothing.

Equal vectors are one row with a multiplicity.  A list is compared in blocks of at most about ``block_rows`` x
``block_rows`` vectors; a block returns link counts per vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import checkpoint, connected_components, spanning_forest

LEAST_COSINE = 0.93
SAMPLE_ROWS = 20_000      # vectors that the codebooks are fitted on, about
LIST_ROWS, BLOCK_ROWS = 512, 1024
SUBSPACES, CODES = 8, 16
SLACK = 0.5
_EPSILON = 1e-9
Codebook = tuple[np.ndarray, list[np.ndarray]]


def unit(vector: np.ndarray | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or not finite throughout."""
    if vector is None or len(vector) == 0:
        return None
    v = np.asarray(vector, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0.0:
        return None
    v = v / most
    return v / np.sqrt((v * v).sum())


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distances [row, centre])."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(axis=1)
    return d.argmin(axis=1), np.maximum(d, 0.0)


def fit_codebook(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> Codebook:
    """Coarse centroids and, per subspace, the centroids of the residuals."""
    coarse = _kmeans(sample, lists, 1)
    rest = sample - coarse[_nearest(sample, coarse)[0]]
    return coarse, [_kmeans(part, codes, 2 + i) for i, part in enumerate(np.array_split(rest, subspaces, axis=1))]


def encode(x: np.ndarray, book: Codebook, margin: float) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """(own list, lists to probe, codes [row, subspace], coding error) of unit vectors."""
    coarse, parts = book
    own, d = _nearest(x, coarse)
    between = np.sqrt(np.maximum(_nearest(coarse, coarse)[1], 1e-18))
    away = (d - d[np.arange(len(x)), own][:, None]) / (2.0 * between[own])   # distance to each list's boundary
    probes = [np.flatnonzero(row <= margin + _EPSILON).tolist() for row in away]
    rest = x - coarse[own]
    codes = np.stack([_nearest(p, c)[0] for p, c in zip(np.array_split(rest, len(parts), axis=1), parts)], axis=1)
    decoded = np.concatenate([c[codes[:, i]] for i, c in enumerate(parts)], axis=1)
    return own, probes, codes, np.sqrt(((rest - decoded) ** 2).sum(axis=1))


def lookup_distances(queries: np.ndarray, centre: np.ndarray, parts: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Distance from each query to each coded vector of a list, by one table of squared distances per subspace."""
    total = np.zeros((len(queries), len(codes)))
    for i, q in enumerate(np.array_split(queries - centre, len(parts), axis=1)):
        total += _nearest(q, parts[i])[1][:, codes[:, i]]
    return np.sqrt(total)


def _compare(frame: pd.DataFrame, books: dict[int, Codebook], least: float) -> pd.DataFrame:
    """Links between the queries and the list rows of one block: (a, b, n), a forest's links with n null and each
    vector's number of links with b null."""
    base, query = frame[frame["base"]], frame[~frame["base"]]
    out: list[pd.DataFrame] = []
    if len(base) and len(query):
        width, number = int(frame["width"].iat[0]), int(frame["list"].iat[0])
        coarse, parts = books[width]
        x = np.frombuffer(b"".join(base["unit"])).reshape(len(base), width)
        q = np.frombuffer(b"".join(query["unit"])).reshape(len(query), width)
        codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
        reach = np.sqrt(max(0.0, 2.0 - 2.0 * least)) + base["error"].to_numpy() + 1e-6
        near = lookup_distances(q, coarse[number], parts, codes) <= reach
        # Each pair once: within a list from the smaller id, across lists from the smaller list, and from the larger one
        # where the vector of the smaller one does not probe back.
        qi, bi, own = query["id"].to_numpy(), base["id"].to_numpy(), query["own"].to_numpy()
        back = np.zeros((len(query), len(base)), bool)
        for other in np.unique(own[own > number]):
            back[own == other] = [other in probes for probes in base["probes"]]
        near &= (own[:, None] != number) & ~back | (own[:, None] == number) & (qi[:, None] < bi[None, :])
        rows, cols = near.any(axis=1), near.any(axis=0)
        cosine = np.where(near[np.ix_(rows, cols)], q[rows] @ x[cols].T, -2.0)
        # The last digits of a matrix product depend on the order of its sums: edge cases are decided one by one.
        i, j = np.nonzero(np.abs(cosine - least) <= _EPSILON)
        cosine[i, j] = [float(np.dot(q[rows][r], x[cols][c])) for r, c in zip(i, j)]
        i, j = np.nonzero(cosine >= least)
        a, b = qi[rows][i], bi[cols][j]
        qm, bm = query["copies"].to_numpy()[rows][i], base["copies"].to_numpy()[cols][j]
        counts = pd.DataFrame({"a": np.concatenate([a, b]), "n": np.concatenate([bm, qm])}).groupby("a", as_index=False).sum()
        out += [counts.assign(b=None), pd.DataFrame(spanning_forest(a, b), columns=["a", "b"]).assign(n=None)]
    whole = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})
    return whole[["a", "b", "n"]].astype("Int64")


def link_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least: float = LEAST_COSINE, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS,
                 sample_rows: int = SAMPLE_ROWS, slack: float = SLACK) -> DataFrame:
    """One row per row of ``rows``: key, n_links, component_id, kept.

    Vectors with equal labels, not null, and of one length are linked where their cosine is at least ``least``.  n_links
    counts the other keys linked directly, component_id is the smallest key that links lead to.  A null key or label and
    a vector that is null, empty, zero or not finite throughout link with nothing; a null key has a null component and
    is kept.  Rows that repeat key, label and vector are one vector; a key with several vectors joins their links.
    Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    margin = slack * float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))

    @F.pandas_udf("width int, unit binary, digest binary")
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            units = [unit(v) for v in vectors]
            yield pd.DataFrame({
                "width": [0 if u is None else len(u) for u in units],
                "unit": [None if u is None else u.tobytes() for u in units],
                "digest": [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]})

    source = rows.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"),
                         scaled(F.col(vector).cast("array<double>")).alias("s")).select("id", "label", "s.*")
    source = checkpoint(source)
    good = source.where("id is not null and label is not null and width > 0")
    # Equal vectors of a label are one, named after the smallest key.
    distinct = good.select("id", "label", "width", "digest").distinct()
    classes = checkpoint(distinct.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    first = good.join(classes.withColumnRenamed("rep", "id"), ["id", "label", "digest"]).dropDuplicates(["id", "label", "digest"])

    sizes = first.groupBy("width", "label").agg(F.count("*").alias("n")).groupBy("width").agg(
        F.sum("n").alias("n"), F.max("n").alias("most")).collect()  # a row per vector length
    total = sum(r["n"] for r in sizes)
    books: dict[int, Codebook] = {}
    if total:
        share = F.pmod(F.xxhash64("id", F.lit("codebook")), F.lit(1 << 20)) / float(1 << 20)
        sample = first.where(share <= min(1.0, sample_rows / total)).select("width", "unit").toPandas()
        for r in sizes:
            width = r["width"]
            of = sample["unit"][sample["width"] == width]
            x = np.frombuffer(b"".join(of)).reshape(len(of), width) if len(of) else np.zeros((1, width))
            books[width] = fit_codebook(x, max(1, min(-(-r["most"] // list_rows), len(x) // 8)))

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                x = np.frombuffer(b"".join(part["unit"])).reshape(len(part), width)
                own, probes, codes, error = encode(x, books[width], margin)
                yield part.assign(own=own, probes=probes, codes=[c.tobytes() for c in codes.astype(np.uint8)], error=error)[
                    ["id", "label", "width", "unit", "copies", "own", "probes", "codes", "error"]]

    index = checkpoint(first.select("id", "label", "width", "unit", "copies").mapInPandas(
        coded, "id long, label string, width int, unit binary, copies long, own int, probes array<int>, "
               "codes binary, error double"))
    # Blocks of a list and chunks of the queries that probe it, from their numbers.
    cell = ["label", "width", "list"]
    asked = index.select("id", "label", "width", "unit", "copies", "own", F.explode("probes").alias("list"))
    blocks = index.groupBy("label", "width", F.col("own").alias("list")).agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    chunks = asked.groupBy(*cell).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    layout = checkpoint(blocks.join(chunks, cell))
    part_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*cell, "block", "chunk", "id", "unit", "copies", "own"]
    base = index.withColumn("list", F.col("own")).join(layout, cell).withColumn("block", part_of("blocks")).withColumn(
        "chunk", every("chunks")).select(*columns, "codes", "error", "probes", F.lit(True).alias("base"))
    query = asked.join(layout, cell).withColumn("chunk", part_of("chunks")).withColumn("block", every("blocks")).select(
        *columns, F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"),
        F.lit(None).cast("array<int>").alias("probes"), F.lit(False).alias("base"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _compare(frame, books, least)

    found = checkpoint(base.unionByName(query).groupBy(*cell, "block", "chunk").applyInPandas(
        compare, "a long, b long, n long"))
    near = connected_components(found.where("b is not null").select("a", "b").union(_one_key(good, classes)))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = good.select("id", "label", "digest").distinct().join(classes, ["label", "digest"]).join(
        links, "rep", "left").join(near.withColumnRenamed("id", "rep"), "rep", "left")
    per_key = named.groupBy("id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.min(F.coalesce("component", "rep")).alias("component"))
    whole = source.select("id").join(per_key, "id", "left")
    component = F.coalesce("component", "id")
    return whole.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _one_key(good: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the vectors of a key that has several."""
    own = good.select("id", "label", "digest").distinct().join(classes, ["label", "digest"])
    many = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).where("a != _z").select("id", "a")
    return own.join(many, "id").select("a", F.col("rep").alias("b"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[]))
    AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
link AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.e) = len(q.e) AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM reach JOIN link ON id = a WHERE b > c),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
number AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN number ON a = vec_id"""
