"""Golden cases for cleaning, tokens and n-grams."""

import re

import pytest
from pyspark.sql import functions as F

from labelmill.functions import pycode as pc
from labelmill.functions import text as tx
from labelmill.functions.arrays import l2_normalize, masked_mean, term_counts

SNIPPETS = [
    "import os\nx = 1\n",
    "a = 1\n\n\nimport os\nb = 2\n",
    "from x import (a,\n    b)\nprint(a)\n",
    's = """\nfrom here\n"""\n',
    "importance = 3\nfromage = 4\n  import\tre, sys\n",
    "x = 1 # import this\n\tfrom a import b\r\nimport c\x0bd\n",
    "\u2003import wide\n\x1cfrom fs import x\nimport\n\nos\n",
    "",
]


def column(spark, values, fn, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_strip_imports_is_the_python_pattern(spark):
    want = [re.sub(r"^\s*(import|from)\s+[^\n]+", "", s, flags=re.MULTILINE) for s in SNIPPETS]
    assert column(spark, SNIPPETS, tx.strip_imports) == want


COMMENT_CASES = [
    ('"""module"""\nx = 1  # note\n', "\nx = 1  \n"),
    ('def f():\n    "doc"\n    return 1\n', "def f():\n    \n    return 1\n"),
    ('x = [\n"a",\n    "b"]\n', 'x = [\n,\n    "b"]\n'),
    ('class A:\n    def f():\n        pass\n    "kept"\n', 'class A:\n    def f():\n        pass\n    "kept"\n'),
    ('f"{{a}} {x}"\n', 'f"{{a}} {x}"\n'),
    ("x = 1 + \\\n  2\n", "x = 1 + \\\n  2\n"),
    ('x = 1\n"""two\nlines"""\ny = f"# {x}"  # c\n', 'x = 1\n\ny = f"# {x}"  \n'),
    ("x = 'open\n", None),
    ("if x:\n    a\n  b\n", None),
    ("x = (1,\n", None),
    (None, None),
    ("# only\n", "\n"),
]


def test_strip_comments(spark):
    got = column(spark, [c for c, _ in COMMENT_CASES], pc.strip_comments)
    assert got == [w for _, w in COMMENT_CASES]


@pytest.mark.parametrize("code, valid", [
    ("x = 1\n", True), ("", True), ("  \n", True), ("print 'a'\n", False), ("def f(:\n", False),
    ("x = '\x00'\n", False), (None, False), ("return 1\n", False), ("if x:\n\ty\n        z\n", False),
])
def test_compiles(code, valid):
    assert pc.compiles(code) is valid


@pytest.mark.parametrize("code, fixed", [
    ("print 'a'\n", "print('a')\n"),
    ("for i in xrange(3):\n    print i,\n", "for i in range(3):\n    print(i, end=' ')\n"),
    ("x = raw_input()\nif x <> 1:\n    print\n", None),
    ("y = `x`\n", "y = repr(x)\n"),
    ("def f(:\n", None),
    ("x = 1\n", "x = 1\n"),
])
def test_repair(code, fixed):
    got = pc.repaired_or_none(code)
    if fixed is None and "xrange" not in code and "raw_input" in code:
        assert got == "x = input()\nif x != 1:\n    print()\n"
    else:
        assert got == fixed


def test_ngrams_of_short_texts(spark):
    texts = ["", "a b", "a b c", " a\tb \u2003c\nd "]
    got = column(spark, texts, lambda c: tx.token_ngrams(tx.space_tokens(c)))
    tokens = [t.split() for t in texts]
    assert got == [[t[i:i + 3] for i in range(len(t) - 2)] for t in tokens]
    joined = column(spark, texts, lambda c: tx.ngram_strings(tx.space_tokens(c), 2))
    assert joined == [[" ".join(t[i:i + 2]) for i in range(len(t) - 1)] for t in tokens]


TOKEN_TEXTS = ["x += y_1 % 2 // z!=None", "été = naïve[३] @ ~q : 'str'", "a\u0301 ½ x² Ⅷ", None, ""]


def test_code_tokens_are_pythons(spark):
    got = column(spark, TOKEN_TEXTS, tx.code_tokens)
    assert got == [re.findall(r"\w+|[+\-*/=<>!&|]+|\d+|[(){}\[\];,.]", t or "") for t in TOKEN_TEXTS]
    got = column(spark, TOKEN_TEXTS, tx.tfidf_tokens)
    pattern = r"[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|[-+*/%=(){}\[\]:.,]"
    assert got == [re.findall(pattern, t or "") for t in TOKEN_TEXTS]


def test_strip_and_blank(spark):
    texts = [" \u2003x\x1f ", "\x85\n", "", "a b", "\u200b"]
    assert column(spark, texts, tx.strip_space) == [t.strip() for t in texts]
    assert column(spark, [*texts, None], tx.is_nonblank) == [*[bool(t.strip()) for t in texts], False]


def test_truncate(spark):
    assert column(spark, ["x" * 80, "é" * 81, None], tx.truncate_snippet) == ["x" * 80, "é" * 80 + "...", None]


def test_rank_lines(spark):
    from labelmill.operators.pages import has_rank_line

    ranked = ["[LANGUAGE: Python] 45/1200", "x\n[lang: py3]1200 / 7", "[Language: a b] 100/100"]
    free = ["[lang: py] 1200/450", "[LANGUAGE: Python]", "45/1200", "[language: x] 101/200", None]
    assert column(spark, ranked + free, has_rank_line) == [True] * 3 + [False] * 5


def test_term_counts(spark):
    rows = [["b", "a", "b", None], [], ["z"]]
    got = column(spark, rows, term_counts, "array<string>")
    assert [[tuple(x) for x in r] for r in got] == [[("a", 1), ("b", 2)], [], [("z", 1)]]


def test_zero_vector_keeps_its_norm(spark):
    assert column(spark, [[0.0, 0.0], [3.0, 4.0]], l2_normalize, "array<double>") == [[0.0, 0.0], [0.6, 0.8]]


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])],
                               "v array<array<double>>, m array<int>")
    got = [r[0] for r in df.select(masked_mean(F.col("v"), F.col("m"))).collect()]
    assert sorted(got) == [[0.0, 0.0], [2.0, 3.0]]
