"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of consecutive words whose words a period q apart are identical, q being the smallest such period, of at
least ``least`` words and ``copies`` periods, that no neighbouring word extends.  Laid on itself q words later, a run
overlaps in at least ``max(least - q, (copies - 1) q)`` words; the minimum over all q is the shortest seed.

* Seeds: all k-grams of a text, numbered by doubling (a gram of 2k words is the pair of its halves' numbers), so equal
  numbers mean equal words, never equal hashes.  The shortest seed serves the lags up to its own length, each doubling
  of it the lags up to the doubled length.  A seed that is as long as a period occurs in a run exactly once a period, so the
  pairs of *neighbouring* occurrences are all that is needed: as many as words, not as pairs of occurrences.
* Extension: a pair at lag q is extended to both sides along its diagonal by the same numbers, largest gram first.  Per lag, a
  table of the furthest word covered skips the pairs that an extension has passed already.

Texts are independent: one row in, one row out, nothing is shuffled.  A task holds one batch of texts and of the
longest text its words times the logarithm of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, COPIES = 24, 3
BATCH_WORDS = 1 << 18    # words whose grams are numbered together; a longer text is a batch of its own
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, n_words bigint, collapsed string"

Prepare = Callable[[list[bytes], str | None], list[bytes]]
Run = tuple[int, int, int]


def shortest_seed(least: int, copies: int) -> int:
    """The words in which any run overlaps itself at its period, at least."""
    return min(max(least - q, (copies - 1) * q) for q in range(1, least + 1))


def _number(keys: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """``n`` numbers: at ``places`` equal ones for equal ``keys``; where a key occurs once, and elsewhere, a negative one of its own."""
    out = -1 - np.arange(n)
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[number] > 1
    out[places[again]] = number[again]
    return out


def _gram_numbers(ids: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the grams made of two numbered grams ``shift`` words apart."""
    left, right = ids[:max(0, len(ids) - shift)], ids[shift:]
    both = np.flatnonzero((left >= 0) & (right >= 0))
    return _number(left[both] * (ids.max(initial=0) + 1) + right[both], both, len(left))


def _word_numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of all texts, a border after each text; a word has another number in another text."""
    out, first = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(first + np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
        out.append(np.array([first + len(seen)]))
        first += len(seen) + 1
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Grams:
    """The numbered grams of a batch: ``sizes`` in words, ascending, each at most twice the one before."""

    def __init__(self, words: np.ndarray):
        self.sizes, self.numbers = [1], [_number(words, np.arange(len(words)), len(words))]

    def grow(self, size: int) -> np.ndarray:
        while self.sizes[-1] < size:
            k = self.sizes[-1]
            shift = min(k, size - k)
            self.numbers.append(_gram_numbers(self.numbers[-1], shift))
            self.sizes.append(k + shift)
        return self.numbers[-1]

    def forward(self, i: int, lag: int) -> int:
        """The first word from ``i`` on that differs from the word ``lag`` later."""
        for k, ids in zip(reversed(self.sizes), reversed(self.numbers)):
            while i + lag < len(ids) and ids[i] == ids[i + lag]:
                i += k
        return i

    def backward(self, i: int, lag: int) -> int:
        """The first of the words before ``i`` that all equal the word ``lag`` later."""
        for k, ids in zip(reversed(self.sizes), reversed(self.numbers)):
            while i >= k and i - k + lag < len(ids) and ids[i - k] == ids[i - k + lag]:
                i -= k
        return i


def find_runs(texts: list[list[bytes]], least: int = LEAST, copies: int = COPIES) -> list[list[Run]]:
    """Per text its runs (start, length, period) by start, then period."""
    if copies < 3:
        raise ValueError("runs have three copies at least: below, neighbouring occurrences do not show every run")
    found: list[list[Run]] = [[] for _ in texts]
    ends = np.cumsum([len(t) + 1 for t in texts])
    longest = max(map(len, texts), default=0)
    grams = Grams(_word_numbers(texts))
    shorter, size = 0, shortest_seed(least, copies)
    covered: dict[int, int] = {}
    while copies * (shorter + 1) <= longest and size <= longest:
        seeds = grams.grow(size)
        again = np.flatnonzero(seeds >= 0)
        if not len(again):
            break
        again = again[np.argsort(seeds[again], kind="stable")]
        lag = np.diff(again)
        pair = (seeds[again[1:]] == seeds[again[:-1]]) & (lag > shorter) & (lag <= size)
        start, lag = again[:-1][pair], lag[pair]
        order = np.lexsort((start, lag))
        for i, q in zip(start[order].tolist(), lag[order].tolist()):
            if i < covered.get(q, 0):
                continue
            end, head = grams.forward(i, q), grams.backward(i, q)
            covered[q] = end
            length = end - head + q
            if length >= max(least, copies * q):
                text = int(np.searchsorted(ends, head, side="right"))
                found[text].append((head - int(ends[text]) + len(texts[text]) + 1, length, q))
        shorter, size = size, 2 * size
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def _batches(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Texts together until they have ``BATCH_WORDS`` words; a long text by itself does not hold up short ones."""
    batch, n = [], 0
    for words in texts:
        if batch and n + len(words) > BATCH_WORDS:
            yield batch
            batch, n = [], 0
        batch.append(words)
        n += len(words) + 1
    if batch:
        yield batch


def periodic_runs(text: Column, key: Column | None = None, prepare: Prepare | None = None, least: int = LEAST,
                  copies: int = COPIES) -> Column:
    """struct<runs, n_words, collapsed> of a text: its runs by start, then period, its number of words, and its words joined by
    blanks without those that only repeat a run's first period.

    Words are separated by ASCII white space.  Null and empty texts have no words and no runs, their collapsed text is empty.
    Runs may overlap; each is reported.  ``prepare`` may change the words of a text, given the key as text (None if it is null).
    """
    @F.pandas_udf(SCHEMA)
    def annotate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            split = ((t or "").encode("utf-8", "surrogatepass").split() for t in texts)
            if prepare is not None:
                split = (prepare(words, k) for words, k in zip(split, keys))
            runs, sizes, collapsed = [], [], []
            for batch in _batches(split):
                for words, found in zip(batch, find_runs(batch, least, copies)):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    sizes.append(len(words))
                    collapsed.append(b" ".join(without_repeats(words, found)).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "n_words": pd.Series(sizes, dtype="int64"),
                                "collapsed": pd.Series(collapsed, dtype=object)})

    return annotate(text, (F.lit(None) if key is None else key).cast("string"))


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """``docs`` with the repeats of periodic runs taken out of ``text``.  Texts without a run stay as they are, white space and
    null included; all rows and columns are kept."""
    name = "_runs"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    out = docs.withColumn(name, periodic_runs(F.col(text), None, None, least, copies))
    return out.withColumn(
        text, F.when(F.size(F.col(name)["runs"]) > 0, F.col(name)["collapsed"]).otherwise(F.col(text))).drop(name)


def strongest(runs: Column) -> Column:
    """The run with the most periods, then the first, then the one of the shortest period; null without runs.  The quotients of
    numbers below 2^26 are told apart exactly."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"),
        r["length"].alias("length"))))


def planted(words: list[bytes], key: str | None) -> list[bytes]:
    """The query's words: of every tenth key, by its crc32, the words from one on repeat with a period, both drawn from it."""
    h = None if key is None else zlib.crc32(key.encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the strongest run's start, length, period and exponent_milli (null without a
    run), runs_sha256, collapsed_sha256."""
    rows = docs.select("doc_id", periodic_runs(F.col("text"), F.col("doc_id"), planted).alias("_r"))
    rows = rows.select("doc_id", F.col("_r.runs").alias("_runs"), F.col("_r.collapsed").alias("_kept"),
                       strongest(F.col("_r.runs")).alias("_best"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id", F.size("_runs").cast("bigint").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("_runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("collapsed_sha256"))
