"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lowered, everything but letters, digits and non-ASCII dropped).  The patterns
are the benchmark's 13-word windows as sequences of word numbers; an item of fewer words is one pattern.  The automaton
reads each document once, word by word, and names every window that ends at a word, so hits come as word
ranges, which map back to offsets of the original text.

The benchmark's (window, item) rows are dealt into blocks of at most about ``block_windows`` rows.  One block, the
usual case, is one automaton that is sent to the executors; a larger benchmark takes more passes over the text
instead of a larger automaton, and the hits of all passes are merged in the row.  The blocks are a table; a pass takes one block
through the driver, and what it found is written beside the rows before the next, so that neither the
driver nor a task ever holds two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import checkpoint, fresh, lower_ascii, stored

WINDOW, BLOCK_WINDOWS = 13, 100_000
HITS = "n_words long, ranges array<int>, items array<string>"
# Fixed value: what is not a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE_FOR_GAP = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD_CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Every byte of a non-ASCII character belongs to a word, so bytes give the words of the characters."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACE_FOR_GAP).split() if text else []


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item string, window string): the distinct windows of each item, words joined by a space."""
    clean = F.filter(F.split(lower_ascii(F.col(text)), GAP), lambda w: w != "")
    rows = benchmark.select(F.col(item).cast("string").alias("item"), clean.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return rows.select("item", "w", F.explode(starts).alias("i")).select(
        "item", F.array_join(F.slice("w", F.col("i") + 1, size), " ").alias("window")).distinct()


def _automaton(patterns: list[tuple[str, list[str]]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Word numbers start at 1; 0 is any word that no pattern has."""
    numbers: dict[bytes, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, items in patterns:
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.encode().split(b" "))
        found.add_word(key, (len(key), items))
    found.make_automaton()
    return found, numbers


def _merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Sorted, joined ranges as start, end, start, end, ..."""
    out: list[int] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan(text: Column, before: Column | None, patterns: list[tuple[str, list[str]]]) -> Column:
    def rows(texts, earlier, named, automaton, numbers):
        get = numbers.get
        for t, ranges, items in zip(texts, earlier, named):
            words = words_of(t)
            hits = [(i, at) for i, at in automaton.iter(tuple([get(w, 0) for w in words]))] if words else []
            if hits:
                old = list(ranges)
                ranges = _merged([(i - n + 1, i + 1) for i, (n, _) in hits] + list(zip(old[::2], old[1::2])))
                items = sorted({x for _, (_, names) in hits for x in names}.union(items))
            yield len(words), list(ranges), list(items)

    @F.pandas_udf(HITS)
    def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        automaton, numbers = _automaton(patterns)
        for texts, ranges, items in batches:
            yield pd.DataFrame(list(rows(texts, ranges, items, automaton, numbers)), columns=["n_words", "ranges", "items"])

    if before is None:
        return scan(text, F.array().cast("array<int>"), F.array().cast("array<string>"))
    return scan(text, before["ranges"], before["items"])


def scan_documents(docs: DataFrame, benchmark: DataFrame, output: str, text: str = "text", item: str = "item_id",
                   size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with the struct column ``output``: n_words, ranges (word offsets, start and end in turn, sorted and
    disjoint) and items (sorted names of the items with occurring windows).

    Null text has no words; an item without words has no window; an item whose name is null marks words but is not
    named; repeated items count once.  An empty benchmark hits nothing.
    """
    listed = windows(benchmark, item, size=size)
    blocks = max(1, -(-listed.count() // block_windows))
    if blocks == 1:
        return docs.withColumn(output, _scan(F.col(text), None, _patterns(listed)))
    listed = stored(listed.withColumn("_block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks))))
    last = None
    for b in range(blocks):
        name = output if b == blocks - 1 else fresh(docs, "_scanned")
        scanned = docs.withColumn(name, _scan(F.col(text), F.col(last) if last else None, _patterns(listed.where(F.col("_block") == b))))
        docs, last = checkpoint(scanned.drop(last) if last else scanned), name
    return docs


def _patterns(block: DataFrame) -> list[tuple[str, list[str]]]:
    """(window, its items) of one block; a window whose items lie in several blocks is a pattern in each."""
    rows = block.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).toLocalIterator()
    return [(r["window"], list(r["items"])) for r in rows] or [("\x00", [])]  # never a word


def n_hit(hits: Column) -> Column:
    total = F.aggregate(
        hits["ranges"], F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("sign")),
        lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))
    return total["sum"]


def contaminated(hits: Column, percent: int = 5) -> Column:
    return (n_hit(hits) > 0) & (100 * n_hit(hits) >= percent * hits["n_words"])


def passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(key, start, end, passage): the hit passages as offsets into the original text, in characters."""
    name = fresh(docs, "_hits")

    @F.pandas_udf("array<struct<start:long,end:long,passage:string>>")
    def original(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, ranges in batches:
            out = []
            for t, r in zip(texts, ranges):
                at = [m.span() for m in _WORD_CHARS.finditer(t)] if len(r) else []
                spans = [(at[s][0], at[e - 1][1]) for s, e in zip(r[::2], r[1::2])]
                out.append([{"start": s, "end": e, "passage": t[s:e]} for s, e in spans])
            yield pd.Series(out, dtype=object)

    hit = scan_documents(docs, benchmark, name, text, **settings).where(F.size(f"{name}.ranges") > 0)
    return hit.select(key, F.explode(original(F.col(text), F.col(f"{name}.ranges"))).alias("_p")).select(key, "_p.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The clean documents, all their columns."""
    name = fresh(docs, "_hits")
    return scan_documents(docs, benchmark, name, text, **settings).where(~contaminated(F.col(name))).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    h = F.col("_hits")
    names = F.array_join(h["items"], ",")
    return scan_documents(docs.select("doc_id", "text"), benchmark, "_hits").select(
        "doc_id", h["n_words"].alias("n_words"), n_hit(h).alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        contaminated(h).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, n, item FROM place JOIN win USING (n, words)),
word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)"""
