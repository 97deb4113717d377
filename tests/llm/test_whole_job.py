"""The operators do their whole job: cases in which a smaller one shows."""

import itertools
import re
from re import _parser as sre

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import licenses, mixlm, pii
from tests.llm import brute


# ---- 1 ----

def test_lm_scores_see_the_words_before(spark):
    """Texts of the same words, none of them twice: in the order of the training texts and shuffled."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) + str(i) for i in range(60)]
    training = [i for i in range(400) if not brute.held_out(i, 10)]
    ordered, shuffled = [i for i in range(400, 500) if brute.held_out(i, 10)][:2]
    rows = [(i, " ".join(words[at] for at in range(k, k + 20))) for i in training for k in [int(rng.integers(0, 40))]]
    text = words[10:40]
    rows += [(ordered, " ".join(text)), (shuffled, " ".join(text[i] for i in rng.permutation(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixlm.score_documents(docs, lang=None).where("held_out").collect()}
    assert got[ordered]["base_score"] == pytest.approx(got[shuffled]["base_score"])
    assert got[ordered]["score"] > 0.5 * got[shuffled]["score"]


def test_lm_contexts_cross_word_borders():
    """The contexts of a byte are the text's bytes before it, and the word before with the bytes of its own word."""
    texts = [b"the cat sat ", b"one cat sat ", b"cat "]
    s = mixlm.stream(texts)
    joined, heads = b" ".join(texts) + b" ", [0, 13, 26]
    assert bytes(s.data) == joined
    def told(i):
        head = max(h for h in heads if h <= i)
        before = joined[head:i]
        word = before.rsplit(b" ", 1)[-1]
        last = before[:len(before) - len(word)].split(b" ")[-2:-1] if b" " in before else [None]
        return [before[-k:] if len(before) >= k else (before, "start") for k in range(1, 6)] + [(last[0], word), word]
    want = [told(i) for i in range(len(joined))]
    for k in range(mixlm.ORDERS):
        for i in range(len(joined)):
            for j in range(i):
                assert (s.context[k, i] == s.context[k, j]) == (want[i][k] == want[j][k]), (k, i, j)


def test_lm_counts_of_the_text_so_far():
    texts = [b"ab abc ab b ", b"ab ab ", b""]
    s = mixlm.stream(texts)
    n0, n1 = mixlm.counts_so_far(s)
    at, seen = 0, {}
    for t, text in enumerate(texts):
        word = b""
        for byte in text + b" ":
            for j in range(8):
                bit, key = byte >> (7 - j) & 1, (t, word, (byte | 256) >> (8 - j))
                assert (n0[at, j], n1[at, j]) == tuple(seen.setdefault(key, [0, 0]))
                seen[key][bit] += 1
            word = b"" if byte == 32 else word + bytes([byte])
            at += 1
    assert at == len(s.data)


def test_lm_word_too_long_for_a_number(spark):
    docs = spark.createDataFrame([(i, "x" + "漢字kq7" * 2000 * (i % 2)) for i in range(20)], "doc_id long, text string")
    assert mixlm.score_documents(docs, lang=None).where(~(F.col("score") > -1e9)).count() == 0


# ---- 6 ----

def ways(pattern):
    """Texts that the expression matches whole: every alternative, every option present and absent."""
    def of(items):
        return ["".join(x) for x in itertools.product(*[one(*item) for item in items])]

    def one(op, arg):
        if op is sre.LITERAL:
            return [chr(arg)]
        if op is sre.IN:
            return [chr(a) if o is sre.LITERAL else chr(a[0]) for o, a in arg]
        if op is sre.BRANCH:
            return [x for way in arg[1] for x in of(way)]
        if op is sre.SUBPATTERN:
            return of(arg[3])
        assert op is sre.MAX_REPEAT, op
        return ([""] if arg[0] == 0 else []) + of(arg[2])

    return sorted(set(of(sre.parse(pattern))))


def brute_labels(text):
    """Labels of the places of all rules that no place of a stronger or equal level contains; no keyword is asked."""
    norm, places = f" {text} ", []
    for i, label, level, _, _, pattern in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
            places.append((m.start(), -m.end(), level, i, label))
    places, kept = sorted(places), set()
    for at, (start, back, level, _, label) in enumerate(places):
        if not any(o[1] <= back and o[2] <= level for o in places[:at]):
            kept.add(label)
    kept |= {label for phrase, label in licenses.BASE if f" {phrase} " in norm}
    return ",".join(sorted(kept))


def test_license_rules_fire_alone(spark):
    """Each alternative of each name and single rule as a whole text, and each sentence around the shortest name."""
    texts = [w for _, name, _ in licenses.NAMES for w in ways(name)]
    texts += [w for _, _, sentence, _ in licenses.SINGLE for w in ways(sentence)]
    texts += [w for _, _, sentence in licenses.TEMPLATES for name in ("mit", "expat", "mit 0") for w in ways(sentence.format(name))]
    want = {t: brute_labels(t) for t in texts}
    assert want["released under the terms of the mit"] and want["mit no attribution"] and want["may not be copied"]
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = licenses.scan_licenses(docs, "scan").select("text", "scan.labels").collect()
    assert {r["text"]: r["labels"] for r in got} == want


def test_license_keywords_are_in_every_match():
    for _, name, words in licenses.NAMES:
        assert all(any(w in f" {text} " for w in words.split("|")) for text in ways(name)), name
    for _, _, sentence, words in licenses.SINGLE:
        assert all(any(w in f" {text} " for w in words.split("|")) for text in ways(sentence)), sentence
    for _, sign, sentence in licenses.TEMPLATES:
        assert all(sign in f" {text} " for text in ways(sentence.format("x"))), sentence


def test_license_other(spark):
    rows = ["Released under the XYZ", "Released under the terms of the MIT", "MIT-0", "may not be redistributed", "mit und ohne",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r["labels"] for r in licenses.digest(docs).orderBy("doc_id").collect()]
    assert got == ["other", "mit", "mit-0", "proprietary", "", "isc"]


# ---- 8 ----

def test_a_long_secret_is_redacted_to_its_end(spark):
    docs = spark.createDataFrame([(1, "password=" + "q7" * 120 + " end"), (2, "token=abc no")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "q7" not in got[1] and got[1].endswith(" end") and got[2] == "token=abc no"


def test_counting_touches_only_the_slots_of_the_text(monkeypatch):
    """The counts of a dense table, from a pass that never adds up whole tables."""
    s = mixlm.stream([b"the cat and the cat", b"the end", b""])
    node, bit = mixlm._node_bit(s.data)
    want = np.zeros((mixlm.SLOTS, 2), np.int64)
    for k in range(mixlm.ORDERS):
        slots = s.slots(k, slice(0, len(s.data)), mixlm._hashed(node))
        # The hash of each predictor, context and node by plain numbers.
        for i in range(len(s.data)):
            for j in range(8):
                mixed = (int(s.context[k, i]) * 0x9E3779B97F4A7C15 + int(node[i, j])) * 0xD6E8FEB86659FD93 % (1 << 64)
                assert slots[i, j] == mixlm.OFFSETS[k] + (mixed >> (64 - mixlm.ORDER_BITS[k]))
        np.add.at(want, (slots.ravel(), bit.ravel()), 1)
    monkeypatch.setattr(mixlm, "_training", lambda frames, tune: [s])
    monkeypatch.setattr(mixlm.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(mixlm.np, "bincount", None)
    got = np.zeros((mixlm.SLOTS, 2), np.int64)
    for frame in mixlm.count_bits(iter(()), False):
        at = frame["block"][0] * mixlm.BLOCK
        block = mixlm._counts(frame["counts"][0]).T
        got[at:at + len(block)] = block
    assert (got == want).all()


def test_repeated_contexts_are_looked_up_once(monkeypatch):
    """The coded words are those of all inputs of all bytes; only word order is looked up for each byte."""
    rng = np.random.default_rng(3)
    table = mixlm.packed_table(*rng.integers(0, 40, (2, mixlm.SLOTS)).astype(np.float32))
    mixer = mixlm.Mixer(rng.normal(0.3, 0.1, mixlm.CELLS).astype(np.float32))
    split = [[*t.split(), b""] for t in [b"the cat and the cat sat " * 30, b"", b"one cat \xc3\xa9t\xc3\xa9 sat " * 9]]
    s = mixlm.stream([b" ".join(words) for words in split])
    every = slice(0, len(s.data))
    gate, node, bit, logits, kinds = mixlm.inputs(s, mixlm.counts_so_far(s), every, table)
    p = mixer.refined(mixer.logits(gate, logits, kinds)[0], node)
    logs = np.log(np.where(bit, p, 1 - p)).reshape(-1, 8).sum(axis=1)
    read, slots = {}, mixlm.Stream.slots

    def counted(self, k, part, node):
        read[k] = read.get(k, 0) + len(node)
        return slots(self, k, part, node)

    monkeypatch.setattr(mixlm.Stream, "slots", counted)
    got = mixlm.score_words(split, table, mixer)
    assert got == pytest.approx(np.add.reduceat(logs, np.flatnonzero(s.place == 0)), rel=1e-4)
    assert read.pop(mixlm.WORD_ORDER) == len(s.data)
    assert set(read) == set(range(mixlm.ORDERS)) - {mixlm.WORD_ORDER} and max(read.values()) < len(s.data) / 10


def test_distinct_bytes_have_the_same_contexts():
    s = mixlm.stream([b"the cat and the cat sat", b"the cat", b"", b"cat and"])
    first, times, which = mixlm.distinct(s)
    own = [k for k in range(mixlm.ORDERS) if k != mixlm.WORD_ORDER]
    told = [(*s.context[own, i], s.data[i], min(s.place[i], mixlm.PLACES - 1)) for i in range(len(s.data))]
    assert len(first) == len(set(told)) and [told[i] for i in first[which]] == told
    assert times.tolist() == [told.count(told[i]) for i in first]


def test_counts_of_groups_of_one_value_and_of_several():
    rng = np.random.default_rng(5)
    s = mixlm.stream([b" ".join(bytes(rng.choice(list(b"ab"), 3)) + b"q" for _ in range(40)), b"same same same"])
    n0, n1 = mixlm.counts_so_far(s)
    seen = {}
    for i, (key, byte) in enumerate(zip(s.key, s.data.tolist())):
        for j in range(8):
            counts = seen.setdefault((key, (byte | 256) >> (8 - j)), [0, 0])
            assert [n0[i, j], n1[i, j]] == counts
            counts[byte >> (7 - j) & 1] += 1
