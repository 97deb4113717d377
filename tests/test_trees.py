"""Syntax-tree operators against a direct reading of their definition."""

import ast
import random
from collections import Counter

from pyspark.sql import functions as F

from labelmill.operators import trees as tr

CODE = [
    "x = 1\n",
    "def f(a, *b, c=None, **d):\n    '''doc'''\n    return g(a)[0].b if a else -c\n",
    "class A(B):\n    y: int = 3\n    async def m(self):\n        async with x as z:\n            yield\n",
    "for i in range(3):\n    print(f'{i!r:>{w}}', *xs, sep='')\nelse:\n    i += 1\n",
    "try:\n    import os.path as p\nexcept (E, F) as e:\n    raise\nfinally:\n    del p\n",
    "match v:\n    case {'k': [1, *rest]} if rest:\n        pass\n    case None | _:\n        pass\n",
    "lam = lambda q: (yield)\nd = {**a, 'b': [u for u in v if u]}\ns = b'x'\nt = ''\nn = ...\n",
    "a and b or not c < d <= e\nglobal z\nw = x = 10**3; assert w, 'é'\n",
    "é = 'ü'\n",
    "",
]
BAD = ["def f(:\n", "x = '\x00'\n", None, "print 'a'\n"]


class Node:
    def __init__(self, node, parent):
        self.kind, self.parent = type(node).__name__, parent
        self.depth = 0 if parent is None else parent.depth + 1
        self.token = tr.node_token(node)
        self.children = [Node(c, self) for c in ast.iter_child_nodes(node)]

    def flat(self):
        return [self] + [x for c in self.children for x in c.flat()]

    def line(self):
        out, at = [], self
        while at is not None and len(out) < 12:
            out.append(at)
            at = at.parent
        return out


def brute_contexts(root):
    nodes, out = root.flat(), []
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:i + 3]:
            up, down = a.line(), b.line()
            common = [x for x in down if any(x is y for y in up)]
            if not common:
                continue
            ups = up[:next(k for k, x in enumerate(up) if x is common[0])]
            downs = down[:next(k for k, x in enumerate(down) if x is common[0])]
            steps = [x.kind + "↑" for x in ups] + ["↓" + x.kind for x in reversed(downs)]
            if 0 < len(steps) <= 6:
                out.append((a.token or a.kind, "→".join(steps), b.token or b.kind))
    return out


def _trees(spark, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code string").repartition(3)
    return tr.parse_trees(df, "code", "id")


def _deep():
    rng = random.Random(7)
    text, indent = "", 0
    for _ in range(60):
        text += "    " * indent + rng.choice(["if a:", "while b(c, 1):", "with d.e as f:"]) + "\n"
        indent += 1
        if indent > 15 or rng.random() < 0.2:
            text += "    " * indent + "x = y[1]\n"
            indent = rng.randrange(0, indent)
    return text + "    " * indent + "pass\n"


def test_nodes_and_contexts(spark):
    codes = [*CODE, _deep()]
    trees = _trees(spark, codes).cache()
    nodes, contexts, counts = {}, {}, {}
    for r in tr.explode_nodes(trees, "id").orderBy("id", "preorder").collect():
        nodes.setdefault(r["id"], []).append((r["node_type"], r["token"], r["parent"], r["depth"], r["n_children"]))
    for r in tr.explode_contexts(trees, "id").orderBy("id", "pos").collect():
        contexts.setdefault(r["id"], []).append((r["start_token"], r["path"], r["end_token"]))
    for r in tr.structural_counts(trees, "id").collect():
        counts.setdefault(r["id"], {})[r["term"]] = r["cnt"]
    texts = {r["id"]: (r["c"], r["t"]) for r in trees.select(
        "id", tr.context_text(F.col("tree")).alias("c"), tr.node_type_text(F.col("tree")).alias("t")).collect()}
    trees.unpersist()
    for i, code in enumerate(codes):
        root = Node(ast.parse(code), None)
        flat = root.flat()
        number = {id(n): k for k, n in enumerate(flat)}
        assert nodes[i] == [
            (n.kind, n.token, -1 if n.parent is None else number[id(n.parent)], n.depth, len(n.children)) for n in flat
        ]
        want = brute_contexts(root)
        assert contexts.get(i, []) == want
        keys = Counter()
        for n in flat:
            keys.update([f"node_type_{n.kind}", f"depth_level_{min(n.depth, 10)}",
                         f"children_count_{min(len(n.children), 5)}"])
        assert counts[i] == dict(keys)
        assert texts[i] == (" ".join("|".join(c) for c in want) or "empty_contexts", " ".join(n.kind for n in flat))


def test_unparsable_code_has_placeholders(spark):
    trees = _trees(spark, BAD)
    rows = trees.select(F.col("tree").isNull().alias("none"), tr.context_text(F.col("tree")).alias("c"),
                        tr.node_type_text(F.col("tree")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(True, "empty_contexts", "empty_nodetypes")] * len(BAD)
    assert tr.structural_counts(trees, "id").count() == 0


def test_non_ascii_retry(spark):
    assert tr.parse_python("x = 1 \u00a0# a\n\u200bprint(x)\n") is not None


def test_tokens():
    def token(code, kind):
        return [tr.node_token(n) for n in ast.walk(ast.parse(code)) if type(n).__name__ == kind]

    assert token("a.b", "Attribute") == ["Name"]
    assert token("f(k=1)", "keyword") == ["Constant"]
    assert token("x = 'y' * 3\n", "BinOp") == ["Mult"]
    assert token("'" + "z" * 60 + "'", "Constant") == ["z" * 50]
    assert token("def f():\n    return\n", "Return") == ["None"]
    assert token("x = '\\ud800'", "Constant") == ["?"]


def test_batches_are_cut_by_nodes(spark, monkeypatch):
    monkeypatch.setattr(tr, "NODES_PER_BATCH", 5)
    got = {r["id"]: r["n"] for r in _trees(spark, CODE).select("id", F.size("tree").alias("n")).collect()}
    assert got == {i: len(Node(ast.parse(c), None).flat()) for i, c in enumerate(CODE)}
