"""Registered queries: Python source checks, cleaning and syntax-tree features on templated code."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import pycode as pc
from labelmill.operators import trees as tr
from labelmill.operators import vectors as vec
from labelmill.operators.cleaning import clean_code as clean
from labelmill.plans.inputs import CODE_FORMS, part_code, rounded, sql_form, sql_text


def syntax_valid(spark, sf):
    return part_code(spark, sf).select("p_partkey", pc.valid_syntax(F.col("code")).alias("valid"))


def repair_code(spark, sf):
    return part_code(spark, sf).select("p_partkey", pc.repair_or_drop(F.col("code")).alias("code"))


def strip_comments(spark, sf):
    return part_code(spark, sf).select("p_partkey", pc.strip_comments(F.col("code")).alias("code"))


def clean_code(spark, sf):
    return part_code(spark, sf).select("p_partkey", clean(F.col("code")).alias("code"))


def _trees(spark, sf):
    return tr.parse_trees(part_code(spark, sf), "code", "p_partkey")


def ast_nodes(spark, sf):
    return tr.explode_nodes(_trees(spark, sf), "p_partkey")


def tree_structural_counts(spark, sf):
    return tr.structural_counts(_trees(spark, sf), "p_partkey")


def tree_path_contexts(spark, sf):
    return tr.explode_contexts(_trees(spark, sf), "p_partkey")


def tree_context_text(spark, sf):
    return _trees(spark, sf).select(
        "p_partkey", tr.context_text(F.col("tree")).alias("contexts"), tr.node_type_text(F.col("tree")).alias("types")
    )


def _tree_tfidf(spark, sf, tokens):
    rows = _trees(spark, sf).select("p_partkey", tokens(F.col("tree")).alias("tokens"))
    n_docs = part_code(spark, sf).agg(F.count("*")).scalar()  # a tree per snippet, so none is parsed to be counted
    return rounded(vec.tfidf(rows, "p_partkey", F.col("tokens"), 7500, 2, n_docs), "weight")


def tfidf_paths(spark, sf):
    return _tree_tfidf(spark, sf, tr.path_fragments)


def tfidf_node_types(spark, sf):
    return _tree_tfidf(spark, sf, tr.node_type_words)


QUERIES = {
    f.__name__: f
    for f in (
        syntax_valid, repair_code, strip_comments, clean_code, ast_nodes, tree_structural_counts, tree_path_contexts,
        tree_context_text, tfidf_paths, tfidf_node_types,
    )
}

# What each code form becomes, by hand.  Comments leave their line and its indentation behind.
_BARE = "def f{k}(x):\n    \n    return x + {s}\n"
_STRIPPED = (
    _BARE,
    "def f{k}(x):\n    \n    \n    return x + {s}\n",
    "import os\nfrom sys import path\n" + _BARE,
    None,
    _BARE + 'print "done"\n',
)
_CLEANED = (*_STRIPPED[:2], "\n\n" + _BARE, *_STRIPPED[3:])
_REPAIRED = (*CODE_FORMS[:3], None, CODE_FORMS[0] + 'print("done")\n')

# The nodes of each code form in preorder, by hand: (parent, depth, type, token, children).
_FORMS = {
    0: [(-1, 0, "Module", None, 1), (0, 1, "FunctionDef", "f{k}", 2), (1, 2, "arguments", None, 1),
        (2, 3, "arg", "x", 0), (1, 2, "Return", "BinOp", 1), (4, 3, "BinOp", "Add", 3), (5, 4, "Name", "x", 1),
        (6, 5, "Load", None, 0), (5, 4, "Add", None, 0), (5, 4, "Constant", "{s}", 0)],
    1: [(-1, 0, "Module", None, 1), (0, 1, "FunctionDef", "f{k}", 3), (1, 2, "arguments", None, 1),
        (2, 3, "arg", "x", 0), (1, 2, "Expr", "Constant", 1), (4, 3, "Constant", "doc", 0),
        (1, 2, "Return", "BinOp", 1), (6, 3, "BinOp", "Add", 3), (7, 4, "Name", "x", 1), (8, 5, "Load", None, 0),
        (7, 4, "Add", None, 0), (7, 4, "Constant", "{s}", 0)],
    2: [(-1, 0, "Module", None, 3), (0, 1, "Import", None, 1), (1, 2, "alias", "os", 0),
        (0, 1, "ImportFrom", None, 1), (3, 2, "alias", "path", 0), (0, 1, "FunctionDef", "f{k}", 2),
        (5, 2, "arguments", None, 1), (6, 3, "arg", "x", 0), (5, 2, "Return", "BinOp", 1), (8, 3, "BinOp", "Add", 3),
        (9, 4, "Name", "x", 1), (10, 5, "Load", None, 0), (9, 4, "Add", None, 0), (9, 4, "Constant", "{s}", 0)],
}


def _node_values() -> str:
    rows = []
    for form, nodes in _FORMS.items():
        for i, (parent, depth, kind, token, children) in enumerate(nodes):
            word = "NULL" if token is None else sql_text(token)
            rows.append(f"({form}, {i}, {parent}, {depth}, '{kind}', {word}, {children})")
    return ", ".join(rows)


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{k}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR)"


NODES_CTE = f"""
WITH RECURSIVE form(form, preorder, parent, depth, node_type, token, n_children) AS (VALUES {_node_values()}),
nodes AS (SELECT p_partkey, preorder, parent, depth, node_type, {_filled('token')} AS token, n_children
          FROM part JOIN form ON form = p_partkey % 5),
up(form, node, above, hop) AS (
  SELECT form, preorder, preorder, 0 FROM form
  UNION ALL SELECT up.form, up.node, f.parent, up.hop + 1 FROM up JOIN form f ON f.form = up.form AND f.preorder = up.above
  WHERE f.parent >= 0),
pair AS (
  SELECT a.form, a.preorder AS i, b.preorder AS j, coalesce(a.token, a.node_type) AS s, coalesce(b.token, b.node_type) AS e
  FROM form a JOIN form b ON a.form = b.form AND b.preorder - a.preorder IN (1, 2)),
lca AS (
  SELECT p.form, i, j, max(x.above) AS top FROM pair p JOIN up x ON x.form = p.form AND x.node = i
  JOIN up y ON y.form = p.form AND y.node = j AND y.above = x.above GROUP BY ALL),
steps AS (
  SELECT l.form, i, j, u.hop AS k, t.node_type || '↑' AS step FROM lca l JOIN up u ON u.form = l.form AND u.node = i AND u.above > top
    JOIN form t ON t.form = l.form AND t.preorder = u.above
  UNION ALL
  SELECT l.form, i, j, 1000 - u.hop, '↓' || t.node_type FROM lca l JOIN up u ON u.form = l.form AND u.node = j AND u.above > top
    JOIN form t ON t.form = l.form AND t.preorder = u.above),
path AS (SELECT form, i, j, string_agg(step, '→' ORDER BY k) AS path FROM steps GROUP BY ALL HAVING count(*) <= 6),
ctx AS (
  SELECT form, (row_number() OVER (PARTITION BY form ORDER BY i, j) - 1)::INT AS pos, s, path, e
  FROM path JOIN pair USING (form, i, j)),
texts AS (
  SELECT p_partkey,
    coalesce({_filled("(SELECT string_agg(s || '|' || path || '|' || e, ' ' ORDER BY pos) FROM ctx WHERE form = p_partkey % 5)")},
             'empty_contexts') AS contexts,
    coalesce((SELECT string_agg(node_type, ' ' ORDER BY preorder) FROM form WHERE form = p_partkey % 5),
             'empty_nodetypes') AS types
  FROM part)
"""


def tfidf_sql(tokens: str, doc: str, max_features: int = 7500, min_df: int = 2) -> str:
    """CTEs over ``tokens(doc, term)`` and ``n_docs(n)``, ending in the weights."""
    return f""",
tf AS (SELECT {doc}, term, count(*) AS cnt FROM {tokens} GROUP BY ALL),
stat AS (SELECT term, count(*) AS df, sum(cnt) AS total FROM tf GROUP BY term HAVING count(*) >= {min_df}
         ORDER BY total DESC, term LIMIT {max_features}),
raw AS (SELECT {doc}, term, cnt * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN stat USING (term), n_docs),
norm AS (SELECT {doc}, sqrt(sum(w * w)) AS norm FROM raw GROUP BY {doc})
SELECT {doc}, term, round(w / norm, 6) AS weight FROM raw JOIN norm USING ({doc})"""


ORACLES = {
    "syntax_valid": "SELECT p_partkey, p_partkey % 5 < 3 AS valid FROM part",
    "repair_code": f"SELECT p_partkey, {sql_form(*_REPAIRED)} AS code FROM part",
    "strip_comments": f"SELECT p_partkey, {sql_form(*_STRIPPED)} AS code FROM part",
    "clean_code": f"SELECT p_partkey, {sql_form(*_CLEANED)} AS code FROM part",
    "ast_nodes": NODES_CTE + "SELECT p_partkey, preorder, parent, depth, node_type, token, n_children FROM nodes",
    "tree_structural_counts": NODES_CTE + """
SELECT p_partkey, term, count(*) AS cnt FROM (
  SELECT p_partkey, unnest(['node_type_' || node_type, 'depth_level_' || least(depth, 10),
                            'children_count_' || least(n_children, 5)]) AS term FROM nodes) GROUP BY ALL""",
    "tree_path_contexts": NODES_CTE + f"""
SELECT p_partkey, pos, {_filled('s')} AS start_token, path, {_filled('e')} AS end_token
FROM part JOIN ctx ON form = p_partkey % 5""",
    "tree_context_text": NODES_CTE + "SELECT p_partkey, contexts, types FROM texts",
    "tfidf_paths": NODES_CTE + """,
tok AS (SELECT p_partkey, unnest(regexp_extract_all(contexts, '[^|→↑↓]+', 0)) AS term FROM texts),
n_docs AS (SELECT count(*) AS n FROM texts)""" + tfidf_sql("tok", "p_partkey"),
    "tfidf_node_types": NODES_CTE + """,
tok AS (SELECT p_partkey, unnest(regexp_extract_all(types, '[\\p{L}\\p{N}_]+', 0)) AS term FROM texts),
n_docs AS (SELECT count(*) AS n FROM texts)""" + tfidf_sql("tok", "p_partkey"),
}
