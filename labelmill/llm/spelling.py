"""Spelling variants of a corpus' words by a trie of letter counts.

Words are near if one inserted, deleted or replaced letter turns one into the other.  A word's letters are counted in groups; the
words are arranged in a trie whose levels are the counts of one group after another, commonest letters first.  A depth-first
search takes a word down the trie and spends a budget of one surplus (a group with a letter more) and one deficit (a letter less);
an edit changes no more than that.  The words of the leaves that it reaches are verified, by what is left of the budget and
then letter by letter.

On Spark the top of the trie (a word's length and the counts of the first ``TOP`` groups) is the key by which words are dealt to
tasks.  A word is laid down in its own part and looks for its partners in every part that its budget reaches, only from the
shorter to the longer word and, at one length, from the smaller part to the larger, so that a pair is met once (within
one part twice, once from either end).  A part of more than
``PART_WORDS`` words or queries is dealt further, by hashes: every piece of its words meets every piece of its queries, so a task
holds two pieces whatever the vocabulary's size, and no pair is lost.  What leaves a task is one row a word that it found near
words for, not the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import stored, stored_counting

LETTERS = "etaoinsrhldcumfpgbvwykxjqz"
OTHER_GROUPS = 4          # groups of all other letters, by code point
GROUPS = len(LETTERS) + OTHER_GROUPS
TOP = 3
PART_WORDS = 20_000
LEAF_WORDS = 64           # a range of so few words is verified instead of split further
_CELLS = 1 << 22          # letters compared at once
_HELD_WORDS = 300_000     # different words that a task counts before it hands them on
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
MIN_LETTERS, MIN_COUNT, DROPPED = 5, 3, 97


def _group_table() -> np.ndarray:
    table = len(LETTERS) + np.arange(1 << 16) % OTHER_GROUPS
    table[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    return table


_GROUP = _group_table()


def codes(words: np.ndarray, length: int) -> np.ndarray:
    """The code points of words of at most ``length`` letters as the rows of a matrix, zeros behind a shorter word."""
    return np.asarray(words, f"U{length}").view(np.uint32).reshape(len(words), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """[word, group] counts of a matrix of code points."""
    n, length = letters.shape
    place = np.repeat(np.arange(n), length) * GROUPS + _GROUP[letters.ravel() & 0xFFFF]
    return np.bincount(place, minlength=n * GROUPS).reshape(n, GROUPS)


def signatures(counts: np.ndarray) -> np.ndarray:
    """Two bits a group, set from one letter and from two letters on: a surplus or a deficit of one changes one bit at most."""
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1).astype(np.uint64)
    return bits @ (np.uint64(1) << np.arange(2 * GROUPS, dtype=np.uint64))


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one edit; ``long`` has as many columns as ``short`` or one more."""
    n, m = short.shape
    if long.shape[1] == m:
        return np.count_nonzero(short != long, axis=1) == 1
    ahead, behind = short == long[:, :-1], short == long[:, 1:]
    prefix = np.where(ahead.all(axis=1), m, ahead.argmin(axis=1))
    suffix = np.where(behind.all(axis=1), m, behind[:, ::-1].argmin(axis=1))
    return prefix + suffix >= m


def search(words: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) positions of all near pairs.  All ``words`` have one length, ``queries`` have it or one letter less."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(queries):
        return none, none
    length = len(words[0])
    letters, asked = codes(words, length), codes(queries, length)
    counts = letter_counts(letters)
    order = np.lexsort(counts.T[::-1])
    letters, counts = letters[order], counts[order]
    shorter = asked[:, -1] == 0
    found = [(none, none)]
    for at, some in ((np.flatnonzero(~shorter), asked[~shorter]), (np.flatnonzero(shorter), asked[shorter, :-1])):
        if some.size:
            for q, w in _descend(counts, letters, some, letter_counts(some)):
                found.append((at[q], order[w]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _descend(counts: np.ndarray, letters: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> Iterator[tuple]:
    """Depth-first search of all queries together: a node is a range of the sorted words, with the queries that reach it and
    what they have spent.  A query one letter short has no deficit left: its one edit is the letter to insert."""
    n, asked_bits, bits = len(asked), signatures(wanted), signatures(counts)
    spent = np.full(n, letters.shape[1] - asked.shape[1])
    stack = [(0, 0, len(counts), np.arange(n), np.zeros(n, np.int64), spent)]
    while stack:
        level, lo, hi, q, surplus, deficit = stack.pop()
        while len(q) and hi - lo > LEAF_WORDS and level < GROUPS:
            column = counts[lo:hi, level]
            heads = np.flatnonzero(np.diff(column)) + 1
            if len(heads):
                ends = [*heads.tolist(), hi - lo]
                for a, b in zip([0, *ends[:-1]], ends):
                    kept = _spend(column[a], wanted[q, level], surplus, deficit)
                    if len(kept[0]):
                        stack.append((level + 1, lo + a, lo + b, q[kept[0]], *kept[1:]))
                q = q[:0]
            else:
                kept, surplus, deficit = _spend(column[0], wanted[q, level], surplus, deficit)
                q, level = q[kept], level + 1
        step = max(1, _CELLS // max(1, (hi - lo) * letters.shape[1]))
        for i in range(0, len(q), step):
            some, word = np.nonzero(np.bitwise_count(asked_bits[q[i:i + step], None] ^ bits[lo:hi]) <= 2)
            some, word = q[i + some], lo + word
            near = _one_edit(asked[some], letters[word])
            if near.any():
                yield some[near], word[near]


def _spend(count: int, wanted: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple:
    """(positions of the queries that can afford this count, their surplus, their deficit)."""
    more = count - wanted
    surplus, deficit = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
    kept = np.flatnonzero((surplus <= 1) & (deficit <= 1))
    return kept, surplus[kept], deficit[kept]


def summaries(words: np.ndarray, n_words: np.ndarray, queries: np.ndarray, n_queries: np.ndarray,
              own: np.ndarray) -> pd.DataFrame:
    """(word, n_near, best_n, best): per word of either side how many words of the other are near it, and the most frequent of
    those, the smallest on a tie.  A pair of an ``own`` query, whose part this is, is also found from its other end, so it
    counts for the query alone."""
    q, w = search(words, queries)
    names, n = np.concatenate([queries, words]), np.concatenate([n_queries, n_words])
    both = ~own[q]
    a = np.concatenate([q, w[both] + len(queries)])
    b = np.concatenate([w + len(queries), q[both]])
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names.astype("U") if len(a) else names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return pd.DataFrame({
        "word": pd.Series(names[a[heads]], dtype=object), "n_near": np.diff(np.r_[heads, len(a)]), "best_n": n[b[heads]],
        "best": pd.Series(names[b[heads]], dtype=object)})


# ---- on Spark ----------------------------------------------------------------------------------

def part_of(word: Column) -> Column:
    """The part of the trie that a word lies in: its length and the counts of the first groups."""
    count = lambda c: F.length(word) - F.length(F.replace(word, F.lit(c), F.lit("")))
    return F.struct(F.length(word).alias("length"), *[count(c).alias(f"c{i}") for i, c in enumerate(LETTERS[:TOP])])


def reachable(part: Column) -> Column:
    """The parts in which a word of ``part`` looks: longer by one letter with at most one of the counts larger by one, or as
    long with at most one count larger and one smaller, the first difference upwards."""
    longer = [(1, {})] + [(1, {i: 1}) for i in range(TOP)]
    equal = [(0, {})] + [(0, {i: 1}) for i in range(TOP)] + [
        (0, {i: 1, j: -1}) for i in range(TOP) for j in range(i + 1, TOP)]
    return F.array(*[
        F.struct((part["length"] + more).alias("length"), *[
            (part[f"c{i}"] + change.get(i, 0)).alias(f"c{i}") for i in range(TOP)])
        for more, change in longer + equal])


def near_words(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of all words of ``vocabulary(word, n)`` that have a near word: how many, and the most
    frequent of them, the smallest in code-point order on a tie.

    Words are distinct; rows with a null or empty word are left out.
    """
    rows = vocabulary.where("word != ''").select("word", "n", part_of(F.col("word")).alias("part"))
    asked = rows.select("word", "n", "part", F.explode(reachable(F.col("part"))).alias("to")).select(
        "word", "n", (F.col("part") == F.col("to")).alias("own"), F.col("to").alias("part"))
    pieces = lambda n: F.ceil(F.col(n) / part_words).cast("int")
    laid = rows.groupBy("part").agg(F.count("*").alias("n_laid"))
    looking = asked.groupBy("part").agg(F.count("*").alias("n_asked"))
    sizes = stored(laid.join(looking, "part").select("part", pieces("n_laid").alias("laid"), pieces("n_asked").alias("asked")))
    piece = lambda count: F.pmod(F.xxhash64("word"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    words = rows.join(sizes, "part").select(
        "part", piece("laid").alias("x"), every("asked").alias("y"), "word", "n", F.lit(True).alias("laid"), F.lit(False).alias("own"))
    queries = asked.join(sizes, "part").select(
        "part", every("laid").alias("x"), piece("asked").alias("y"), "word", "n", F.lit(False).alias("laid"), "own")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        laid = group["laid"].to_numpy(bool)
        words, n = group["word"].to_numpy(object), group["n"].to_numpy(np.int64)
        return summaries(words[laid], n[laid], words[~laid], n[~laid], group["own"].to_numpy(bool)[~laid])

    found = words.unionByName(queries).groupBy("part", "x", "y").applyInPandas(
        compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def group_variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary(word, n)``.

    The form is the most frequent near word (the smallest on a tie) if it is at least ``ratio`` times as frequent, else null;
    the root is where the forms lead from a word, the word itself without a form.  Counts grow along the forms, so they never
    lead in a circle; roots are found by pointer doubling, with equi-joins only.
    """
    near = near_words(vocabulary)
    has_form = F.col("best_n") >= ratio * F.col("n")
    rows = stored(vocabulary.where("word != ''").join(near, "word", "left").select(
        "word", F.when(has_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best_n")).alias("form_n")))
    hooks, moving = stored_counting(rows.where("form is not null").select("word", F.col("form").alias("to")), F.lit(True))
    while moving:
        onward = hooks.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        hooks, moving = stored_counting(
            hooks.join(onward, "to", "left").select(
                "word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")), F.col("_moved"))
        hooks = hooks.drop("_moved")
    return rows.join(hooks.withColumnRenamed("to", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def latin_words(text: str) -> Counter:
    """The runs of Latin letters of a text, A-Z lowered, as Latin-1 bytes."""
    return Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))


def misspelt(key: str, word: bytes, one_in: int = DROPPED) -> bytes:
    """The query's words: of one in ``one_in`` words of a document, by a hash of key and word, one letter is deleted."""
    h = zlib.crc32(f"{key}:{word.decode('latin-1')}".encode())
    if h % one_in:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def count_words(docs: DataFrame, text: str = "text", key: str | None = None, min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters that occur at least ``min_count`` times in all texts.

    A task adds up its words before they are shuffled.  Null and empty texts have no words; rows repeated are counted again.
    With a ``key`` the words are those of ``misspelt``; a null key is the empty text.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        out = lambda: pd.DataFrame({
            "word": pd.Series([w.decode("latin-1") for w in held], dtype=object),
            "n": np.fromiter(held.values(), np.int64, len(held))})
        for rows in batches:
            for t, k in zip(rows["text"], rows["key"]):
                for word, n in latin_words(t or "").items():
                    if key is not None:
                        word = misspelt(k or "", word)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(text).alias("text"), (F.lit(None) if key is None else F.col(key)).cast("string").alias("key"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def digest(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    return group_variants(stored(count_words(docs, "text", "doc_id")))


ORACLE = r"""
WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, k:
    CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS key,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents),
u AS (SELECT key, w, count(*) AS n FROM runs GROUP BY ALL),
b AS (SELECT w, n, hex(encode(key || ':' || w)) AS x FROM u),
h AS (
  SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, o: xor(c >> 8, tab[(xor(c, o) & 255) + 1]))) AS h
  FROM b, t),
v AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
p AS (
  SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
near AS (SELECT x AS word, count(*) AS n_near, min({'m': -w.n, 'y': y}) AS best FROM p JOIN w ON w.word = p.y GROUP BY x),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * w.n THEN best.y END AS form,
         CASE WHEN -best.m >= 2 * w.n THEN -best.m END AS form_n
  FROM w LEFT JOIN near USING (word)),
r AS (
  WITH RECURSIVE chain AS (
    SELECT word, word AS at FROM f
    UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
  SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""
