"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation shuffles the shingle space; a second one, shifted circularly by 0, 1, 2, ..., gives every signature
coordinate, so 160 coordinates need two permutations instead of 160.  Signatures are banded; documents that
share a band are candidates and are confirmed on their full shingle sets.

No bucket is expanded into its pairs.  Texts with equal sets are one class.  In a bucket every member is first
compared with one member, its centre: the one that shares buckets with most others over all bands.  An original
and its many edited copies agree with the original more often than with each other, so the original is the
centre and links most of them.  What that leaves, members outside the centre's component and those that the triangle
inequality of the Jaccard distance does not rule out as their partners, forms clumps: what shares a bucket, over
all bands.  A clump is compared in blocks of about 512 x 512 documents, whose intersection sizes are one product of
0/1 matrices; a block returns a spanning forest of its links.

Classes, buckets, centres and results are joined by sorting, so no copy of them passes the driver; links and components are
left to Spark, which broadcasts a side below its threshold only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import checkpoint, checkpoint_counting, connected_components, spanning_forest

BANDS, ROWS = 32, 5            # a pair of similarity 0.8 shares no band with probability 0.672^32 = 3e-6
WIDTH, PERCENT = 5, 80         # words per shingle, least similarity in percent
_CHUNK = 4096                  # shingles signed at a time
_TEXTS = 500                   # texts whose sets leave a task's worker together


class _WordHash(dict):
    """64-bit word hashes, computed once per distinct word of a batch."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_set(text: str | None, width: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(words) - take + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(_mix64(out))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: the k-th coordinate is the least pi(sigma(x) + k) over the set, modulo 2^32.
    sigma is the upper half of the shingle's hash, pi the finaliser below, a bijection of 32-bit numbers."""
    sigma = (shingles >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), _CHUNK):
        x = sigma[at:at + _CHUNK, None] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(best, x.min(axis=0), out=best)
    return best


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64)
    for column in sig.reshape(bands, -1).T:
        key = key * np.uint64(0x9E3779B97F4A7C15) + column
        key ^= key >> np.uint64(31)
    return _mix64(key).view(np.int64)


def _sketch(text: Column, width: int, bands: int, rows: int) -> Column:
    @F.arrow_udf("n long, digest binary, bands array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for texts in batches:
            cache, out = _WordHash(), []
            for t in texts:  # one at a time: no second copy of the batch
                s = shingle_set(t.as_py(), width, cache)
                if len(s):
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                _band_keys(signature(s, bands * rows), bands)))
                else:
                    out.append((0, None, None))
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in out], kind.field(i).type) for i in range(3)], fields=list(kind))

    return sketch(text)


def _shingles(text: Column, width: int) -> Column:
    @F.arrow_udf("array<long>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            cache = _WordHash()
            for at in range(0, len(texts), _TEXTS):
                sets = [shingle_set(t.as_py(), width, cache).view(np.int64) for t in texts.slice(at, _TEXTS)]
                starts = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(sets)))

    return shingles(text)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, na, nb): every candidate pair with the sizes of its sets and of their intersection."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("shingles").alias(f"_{end}")), end)
    return pairs.select("a", "b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("inter"),
                        F.size("_a").cast("long").alias("na"), F.size("_b").cast("long").alias("nb"))


def _intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """[i, j] number of shingles that set i of ``a`` shares with set j of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for side in (a, b):
        sides.append((np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])))
    common = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for flat, row in sides:
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], row[hit][order]))
    for low in range(0, len(common), columns):
        parts = []
        for (at, row), side in zip(placed, (a, b)):
            s = slice(*np.searchsorted(at, [low, low + columns]))
            m = np.zeros((len(side), min(columns, len(common) - low)), np.float32)
            m[row[s], at[s] - low] = 1.0
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _compare_clumps(clumps: DataFrame, sets: DataFrame, comp: DataFrame, percent: int,
                    rows: int = 512) -> tuple[DataFrame, int]:
    """Links (a, b) between documents of one clump and different components, thinned to a forest per block; their number."""
    sizes = clumps.groupBy("component").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")).withColumnRenamed(
        "component", "clump")
    member = clumps.withColumnRenamed("component", "clump").join(sizes, "clump")
    member = member.join(comp.select("id", F.col("component").alias("comp")), "id", "left").withColumn(
        "comp", F.coalesce("comp", "id")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("clump", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                           "block", "id", "comp").join(sets, "id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = int(frame["low"].iat[0]), int(frame["high"].iat[0])
        frame = frame.sort_values("id", kind="stable")
        a, b = frame[frame["block"] == low], frame[frame["block"] == high]
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(a) or not len(b) or frame["comp"].nunique() < 2:
            return empty
        left, right = list(a["shingles"]), list(b["shingles"])
        na, nb = (np.array([len(x) for x in side], np.int64) for side in (left, right))
        inter = _intersections(left, right)
        link = 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)
        link &= a["comp"].to_numpy()[:, None] != b["comp"].to_numpy()[None, :]
        i, j = np.nonzero(link)
        found = spanning_forest(a["comp"].to_numpy()[i], b["comp"].to_numpy()[j])
        return pd.DataFrame(found, columns=["a", "b"]) if found else empty

    return checkpoint_counting(member.groupBy("clump", "low", "high").applyInPandas(compare, "a long, b long"),
                               F.col("a").isNotNull())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: (key, n_shingles, component_id, kept).

    Words are what white space separates, with A-Z lowered.  Documents are linked where
    100 * intersection >= ``percent`` * union of their shingle sets; component_id is the smallest key that
    links lead to and kept marks the document that has it.  A document without words links with nothing.
    Rows that share a key are one document, linked by any of its texts.  A row with a null key links with
    nothing; its component is null and it is kept.  Other columns are not read; an empty table gives no rows.
    """
    far = 1.0 - percent / 100.0
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    seen = checkpoint(source.select("id", _sketch(F.col("text"), width, bands, rows).alias("s")).select("id", "s.*"))
    real = seen.where("digest is not null and id is not null")

    # Equal sets are one class, named after its smallest document, which alone goes on.
    classes = checkpoint(real.groupBy("digest").agg(F.min("id").alias("rep")))
    member = real.join(classes.hint("merge"), "digest").select("id", "rep", "n", "bands")
    banded = member.where("id = rep").select("id", "n", F.posexplode("bands").alias("band", "hash")).distinct()

    # Every member of a bucket against its centre.
    bucket = banded.groupBy("band", "hash").agg(F.count("*").alias("m")).where("m > 1")
    shared = checkpoint(banded.join(bucket.hint("merge"), ["band", "hash"]))
    ranked = shared.join(shared.groupBy("id").agg(F.sum("m").alias("company")).hint("merge"), "id")
    top = ranked.groupBy("band", "hash").agg(F.max("company").alias("company"))
    # The smallest of those with most company; two aggregates of numbers, which combine before the shuffle.
    centres = ranked.join(top.hint("merge"), ["band", "hash", "company"]).groupBy("band", "hash").agg(F.min("id").alias("centre"))
    placed = checkpoint(shared.join(centres.hint("merge"), ["band", "hash"]))
    starred = placed.where("id != centre").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
    wanted = placed.select("id").distinct()
    sets = checkpoint(source.join(wanted.hint("merge"), "id", "left_semi").select(
        "id", _shingles(F.col("text"), width).alias("shingles")).distinct())
    union = F.col("na") + F.col("nb") - F.col("inter")
    linked = 100 * F.col("inter") >= percent * union
    stars = checkpoint(_verify(starred, sets).groupBy("a", "b").agg(
        F.max(linked).alias("linked"), F.min(1.0 - F.col("inter") / union).alias("d"),
        F.max(1.0 - F.col("inter") / union).alias("d_most")))
    # A key with several texts holds their classes together.
    many = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).where("a != _z").select("id", "a")
    same = member.join(many, "id").select("a", F.col("rep").alias("b"))
    near = connected_components(stars.where("linked").select("a", "b").union(same))

    # Members outside the centre's component against the rest of their bucket.
    comp = near.select("id", "component")
    whole = placed.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    whole = whole.join(comp.select(F.col("id").alias("centre"), F.col("component").alias("_c")), "centre", "left")
    whole = whole.withColumn("home", F.coalesce("_c", "centre")).drop("_c")
    whole = whole.where("m > 2 and id != centre").withColumn("a", F.least("id", "centre")).withColumn(
        "b", F.greatest("id", "centre"))
    whole = checkpoint(whole.join(stars.select("a", "b", "d", "d_most"), ["a", "b"]))
    stray = F.col("comp") != F.col("home")
    # A partner of a stray member is at most ``far`` nearer to the centre.
    nearest = whole.groupBy("band", "hash").agg(F.min(F.when(stray, F.col("d"))).alias("nearest"))
    open_rows = whole.join(nearest, ["band", "hash"]).where(stray | (F.col("d_most") >= F.col("nearest") - far - 1e-9))
    open_rows = checkpoint(open_rows.select("band", "hash", "id", "comp"))
    first = open_rows.groupBy("band", "hash").agg(F.min("id").alias("a"))
    clumps = connected_components(open_rows.join(first, ["band", "hash"]).select("a", F.col("id").alias("b")).distinct())
    more, found = _compare_clumps(clumps, sets, comp, percent)
    final = connected_components(more) if found else None

    comp = near if final is None else near.join(
        final.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left"
    ).select("id", F.coalesce("_to", "component").alias("component"))
    if final is not None:  # documents that only the second comparison linked
        alone = final.join(near.select("id"), "id", "left_anti")
        comp = comp.unionByName(alone.select("id", "component")).distinct()
    return _result(seen, classes, comp, key)


def _result(seen: DataFrame, classes: DataFrame, comp: DataFrame, key: str) -> DataFrame:
    """A document's component is its class's."""
    own = seen.where("digest is not null and id is not null").join(classes.hint("merge"), "digest").select("id", "rep")
    own = own.join(comp.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    own = own.groupBy("id").agg(F.min("component").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    rows = seen.select("id", "n").join(own.hint("merge"), "id", "left").withColumn("_c", component)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("_c").alias("component_id"),
                       F.col("id").eqNullSafe(F.col("_c")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: all columns, rows with a null key stay."""
    out = near_duplicates(docs, key, **settings).where("not kept").select(key).distinct()
    return docs.join(out, key, "left_anti")


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y USING (s)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reach JOIN link ON id = a WHERE b > c),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least ON id = doc_id LEFT JOIN size USING (doc_id)"""
