"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary.  A word's probability is the sum over all its
segmentations into pieces, computed by the forward algorithm on the lattice of pieces that occur in it; a text's
is the product over its words.  The piece probabilities are learned by expectation maximisation (forward-backward) on
the word counts of a bounded sample of labelled documents.

A word is a run of bytes without ASCII white space, lowered, with a blank before it, however long.  Every single byte is a
piece, so every word has a segmentation.  Along a long word the forward and backward values are rescaled every ``RESCALE`` bytes.

The vocabulary is an input: a file of base64 pieces and ranks that the driver reads.  Languages are a list that one can loop over: the
model has a row of piece probabilities for each.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import checkpoint, fresh, held_out

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SAMPLE_DOCS = 2000        # labelled documents per language that the probabilities are learned from, about
ROUNDS, SMOOTHING = 3, 0.01
RESCALE = 24              # bytes after which the values along a word are brought back to 1
UNKNOWN = "und"
_CACHE_WORDS = 40_000     # distinct words whose probabilities a task keeps
_TEXTS = 500              # texts whose words are scored together
_LATTICE_BYTES = 1 << 16  # bytes of the words whose lattice is held at once; a longer word has one of its own


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces: lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def as_string(word: bytes) -> str:
    """The word with its blank as a string of one character a byte."""
    return " " + word.decode("latin-1")


def in_blocks(strings: list[str]) -> Iterator[list[int]]:
    """Positions of the strings, by length, in blocks of about ``_LATTICE_BYTES``."""
    block, held = [], 0
    for i in sorted(range(len(strings)), key=lambda i: len(strings[i])):
        if block and held + len(strings[i]) > _LATTICE_BYTES:
            yield block
            block, held = [], 0
        block.append(i)
        held += len(strings[i])
    if block:
        yield block


class Lattice:
    """All pieces in a list of strings as arcs between states; a string of n bytes has n + 1 states."""

    def __init__(self, strings: list[str], automaton, lengths: np.ndarray):
        self.sizes = np.fromiter(map(len, strings), np.int32, len(strings))
        offset = np.cumsum(self.sizes) - self.sizes
        self.first = (offset + np.arange(len(strings))).astype(np.int32)
        self.last = self.first + self.sizes
        self.states = int(self.last[-1]) + 1 if len(strings) else 0
        self.reach = int(lengths.max())
        found = np.fromiter(chain.from_iterable(automaton.iter("".join(strings))), np.int32)
        end, piece = found[::2] + 1, found[1::2]
        owner = (np.searchsorted(offset, end - 1, side="right") - 1).astype(np.int32)
        depth, length = (end - offset[owner]).astype(np.int32), lengths[piece].astype(np.int32)
        inside = length <= depth
        end, piece, owner, depth, length = (x[inside] for x in (end, piece, owner, depth, length))
        order = np.argsort(depth, kind="stable")
        self.piece, self.owner, self.depth = piece[order], owner[order], depth[order]
        self.end = (end + owner)[order]
        self.start = self.end - length[order]
        self.cuts = np.searchsorted(self.depth, np.arange(1, (depth.max() if len(depth) else 0) + 2))
        # Bytes after which values are rescaled: their number is the largest any string needs.
        self.marks = int(self.sizes.max(initial=0)) // RESCALE

    def _layers(self):
        return [(d, slice(a, b)) for d, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:]), 1)]

    def _rescale(self, values: np.ndarray, logs: np.ndarray, mark: int, low: int, high: int) -> None:
        """Divide each long enough string's values at the depths low .. high by their largest, and note its logarithm."""
        long = np.flatnonzero(self.sizes >= mark * RESCALE)
        at = self.first[long][:, None] + np.arange(max(low, 0), high + 1)
        window = values[..., at]
        top = window.max(axis=-1, keepdims=True)
        values[..., at] = window / top
        logs[..., long, mark - 1] = np.log(top[..., 0])

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed probability of all ways from a string's first state to each state, logarithms taken out at each mark);
        ``p`` has a value per arc on its last axis.  A state's value lacks those of the marks less than ``reach`` beyond it."""
        alpha = np.zeros((*p.shape[:-1], self.states))
        logs = np.zeros((*p.shape[:-1], len(self.sizes), self.marks))
        alpha[..., self.first] = 1.0
        for depth, layer in self._layers():
            ends = self.end[layer]
            if len(ends):
                ways = alpha[..., self.start[layer]] * p[..., layer]
                heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
                alpha[..., ends[heads]] = np.add.reduceat(ways, heads, axis=-1)
            if depth % RESCALE == 0:
                self._rescale(alpha, logs, depth // RESCALE, depth - self.reach + 1, depth)
        return alpha, logs

    def backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from a string's last state; a state's value lacks the logarithms of the marks beyond it."""
        beta = np.zeros((*p.shape[:-1], self.states))
        logs = np.zeros((*p.shape[:-1], len(self.sizes), self.marks))
        beta[..., self.last] = 1.0
        for depth, layer in reversed(self._layers()):
            # Arcs of one layer end at one depth, so a string has at most one of them from each state.
            beta[..., self.start[layer]] += p[..., layer] * beta[..., self.end[layer]]
            if depth % RESCALE == 0:
                self._rescale(beta, logs, depth // RESCALE, depth - self.reach, depth - 1)
        return beta, logs

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """Logarithm of each string's probability."""
        alpha, logs = self.forward(p)
        return np.log(alpha[..., self.last]) + logs.sum(axis=-1)

    def uses(self, p: np.ndarray) -> np.ndarray:
        """Expected uses of each arc, given its string; ``p`` is one value per arc."""
        (alpha, taken), (beta, later) = self.forward(p), self.backward(p)
        total = np.log(alpha[self.last]) + taken.sum(axis=1)
        before = np.concatenate([np.zeros((len(self.sizes), 1)), np.cumsum(taken, axis=1)], axis=1)
        after = np.concatenate([np.cumsum(later[:, ::-1], axis=1)[:, ::-1], np.zeros((len(self.sizes), 1))], axis=1)
        start_depth, end_depth = self.depth - (self.end - self.start), self.depth
        marks = np.minimum((start_depth + self.reach - 1) // RESCALE, self.sizes[self.owner] // RESCALE)
        with np.errstate(divide="ignore"):
            logs = np.log(alpha[self.start]) + np.log(p) + np.log(beta[self.end]) - total[self.owner]
        return np.exp(logs + before[self.owner, marks] + after[self.owner, end_depth // RESCALE])


def build_automaton(pieces: list[bytes]):
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(pieces):
        found.add_word(p.decode("latin-1"), i)
    found.make_automaton()
    return found, np.array([len(p) for p in pieces], np.int64)


def expected_counts(strings: list[str], lang: np.ndarray, weight: np.ndarray, p: np.ndarray, automaton,
                    lengths: np.ndarray) -> np.ndarray:
    """[language, piece] expected uses of the pieces in strings of the given languages and weights."""
    out = np.zeros(p.shape)
    for block in in_blocks(strings):
        net = Lattice([strings[i] for i in block], automaton, lengths)
        langs = lang[block][net.owner]
        np.add.at(out, (langs, net.piece), weight[block][net.owner] * net.uses(p[langs, net.piece]))
    return out


class Model:
    """Piece probabilities and prior per language, languages in sorted order."""

    def __init__(self, langs: list[str], pieces: list[bytes], p: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.p, self.prior = langs, pieces, p, prior

    def word_scores(self, words: list[bytes], automaton, lengths: np.ndarray) -> np.ndarray:
        """[language, word] natural log of the words' probabilities."""
        strings = [as_string(w) for w in words]
        out = np.zeros((len(self.langs), len(words)))
        for block in in_blocks(strings):
            net = Lattice([strings[i] for i in block], automaton, lengths)
            out[:, block] = net.log_totals(self.p[:, net.piece])
        return out


class Scorer:
    """A task's automaton and the scores of the words that it has met lately: a table that grows by doubling."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton, self.lengths = build_automaton(model.pieces)
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((len(model.langs), 1 << 12))

    def best(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior."""
        split = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        n = len(self.known) + len(new)
        if n > self.table.shape[1]:
            more = max(n, 2 * self.table.shape[1]) - self.table.shape[1]
            self.table = np.concatenate([self.table, np.zeros((len(self.table), more))], axis=1)
        self.table[:, len(self.known):n] = self.model.word_scores(new, self.automaton, self.lengths)
        self.known.update(zip(new, range(len(self.known), n)))
        return [self._best(words) for words in split]

    def _best(self, words: list[bytes]) -> tuple[str, float]:
        if not words:
            return UNKNOWN, 0.0
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        total = self.model.prior + self.table[:, at].sum(axis=1)
        top = int(total.argmax())
        return self.model.langs[top], float(1.0 / np.exp(total - total[top]).sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary: str = VOCABULARY,
        sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model | None:
    """Learn from rows with a language and a text.  About ``sample_docs`` documents of each language are used, chosen by a
    hash of the key; None if there is no labelled row."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    pieces = read_pieces(vocabulary)
    share = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    keep = F.create_map(*chain.from_iterable(
        (F.lit(c), F.lit(min(1.0, sample_docs / sizes[c]))) for c in langs))[F.col("lang")]
    number = F.create_map(*chain.from_iterable((F.lit(c), F.lit(i)) for i, c in enumerate(langs)))[F.col("lang")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[tuple[int, bytes]] = Counter()
            for number, text in zip(batch["lang"], batch["text"]):
                seen.update((number, w) for w in words_of(text))
            yield pd.DataFrame({"lang": [k[0] for k in seen], "word": [k[1] for k in seen], "n": list(seen.values())})

    counts = checkpoint(
        rows.where(share < keep).select(number.alias("lang"), "text").mapInPandas(count, "lang long, word binary, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")))

    p = np.full((len(langs), len(pieces)), 1.0 / len(pieces))
    for _ in range(rounds):
        p = _round(counts, p, pieces)
    prior = np.log(np.array([sizes[c] for c in langs]) / sum(sizes.values()))
    return Model(langs, pieces, p, prior)


def _round(counts: DataFrame, p: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """One round of expectation maximisation: tasks sum the expected uses of pieces, at most one row per language and
    piece each, and the driver gets their totals."""
    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, lengths = build_automaton(pieces)
        total = np.zeros(p.shape)
        for rows in batches:
            total += expected_counts([as_string(w) for w in rows["word"]], rows["lang"].to_numpy(np.int64),
                                     rows["n"].to_numpy(float), p, automaton, lengths)
        lang, piece = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "piece": piece, "used": total[lang, piece]})

    used = counts.mapInPandas(expect, "lang long, piece long, used double").groupBy("lang", "piece").agg(
        F.sum("used").alias("used")).toPandas()
    out = np.full(p.shape, SMOOTHING)
    out[used["lang"].to_numpy(), used["piece"].to_numpy()] += used["used"].to_numpy()
    return out / out.sum(axis=1, keepdims=True)


def predict(text: Column, model: Model | None) -> Column:
    """struct<lang, score>: the language with the largest posterior (the first by name on a tie) and that posterior;
    ``und`` with score 0 for null text, text without a letter, and without a model."""
    @F.pandas_udf("lang string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if model is None:
            for texts in batches:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
            return
        scorer = Scorer(model)
        for texts in batches:
            found = [scorer.best(texts.iloc[i:i + _TEXTS]) for i in range(0, len(texts), _TEXTS)]
            yield pd.DataFrame(list(chain.from_iterable(found)), columns=["lang", "score"])

    return best(text)


def identify(docs: DataFrame, output: str, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``output``: lang and score."""
    return docs.withColumn(output, predict(F.col(text), model))


def keep_identified(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents with a predicted language whose posterior is at least ``least``; all their columns."""
    name = fresh(docs, "_language")
    out = identify(docs, name, model, text)
    return out.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 5)
    model = fit(docs.select("doc_id", "text", "lang").where(~out))
    return identify(docs.select("doc_id", "text"), "_l", model).select(
        "doc_id", out.alias("held_out"), F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))
