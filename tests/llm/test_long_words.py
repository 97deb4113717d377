"""Language identification: words of any length against the recursion, and texts without a letter."""

import math

import numpy as np
import pytest

from labelmill.llm import langid

PIECES = [bytes([i]) for i in range(256)] + [b" a", b"ab", b"abc", b"bca", b"ca", "\u6f22".encode(), "\u6f22\u5b57".encode(), b"a" * 40]


def tables(langs=2):
    p = np.random.default_rng(7).random((langs, len(PIECES)))
    return p / p.sum(axis=1, keepdims=True)


def recursion(word, p):
    """Logarithm of the sum over all segmentations, each step taken in logarithms."""
    s = b" " + word
    log = [0.0] + [-math.inf] * len(s)
    for i in range(1, len(s) + 1):
        ways = [log[i - len(x)] + math.log(p[k]) for k, x in enumerate(PIECES) if s[:i].endswith(x) and len(x) <= i]
        top = max(ways)
        log[i] = top + math.log(sum(math.exp(w - top) for w in ways))
    return log[-1]


WORDS = [b"abc", b"", b"abcabc" * 4, b"abca" * 25, ("\u6f22\u5b57a" * 40).encode(), b"a" * 333, b"x", b"bca" * 8, b"q" * 23, b"q" * 24]


def test_words_of_any_length_equal_the_recursion():
    p = tables()
    model = langid.Model(["x", "y"], PIECES, p, np.zeros(2))
    got = model.word_scores(WORDS, *langid.build_automaton(PIECES))
    for i, w in enumerate(WORDS):
        for k in range(2):
            assert got[k, i] == pytest.approx(recursion(w, p[k]), rel=1e-9), (w, k)


def test_blocks_do_not_change_scores(monkeypatch):
    model = langid.Model(["x", "y"], PIECES, tables(), np.zeros(2))
    automaton = langid.build_automaton(PIECES)
    whole = model.word_scores(WORDS, *automaton)
    monkeypatch.setattr(langid, "_LATTICE_BYTES", 30)
    assert np.allclose(whole, model.word_scores(WORDS, *automaton))


def test_expected_uses_of_long_words():
    """The expected use of a piece is the derivative of the word's log probability by the log of the piece's."""
    p = tables(1)
    automaton = langid.build_automaton(PIECES)
    for word in (b"abca" * 25, b"abc", b"a" * 120):
        got = langid.expected_counts([langid.as_string(word)], np.array([0]), np.array([3.0]), p, *automaton)[0]
        for piece in (b"a", b"ab", b"bca", b"a" * 40):
            k, step = PIECES.index(piece), 1e-6
            up, down = p[0].copy(), p[0].copy()
            up[k] *= math.exp(step)
            down[k] *= math.exp(-step)
            assert got[k] == pytest.approx(3 * (recursion(word, up) - recursion(word, down)) / (2 * step), abs=1e-4)
        assert np.isfinite(got).all()


def test_very_long_word_is_finite():
    model = langid.Model(["x"], PIECES, tables(1), np.zeros(1))
    got = model.word_scores([b"abc" * 20_000], *langid.build_automaton(PIECES))
    assert np.isfinite(got).all() and got[0, 0] < -1000


def test_letters():
    scorer = langid.Scorer(langid.Model(["x"], PIECES, tables(1), np.zeros(1)))
    got = scorer.best(["\u00b2", "\u00bd \u2460 \u2167", "12 !", "", None, "a", "\u6f22"])
    assert [g[0] for g in got] == ["und"] * 5 + ["x", "x"]
