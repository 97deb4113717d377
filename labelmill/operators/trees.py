"""Syntax trees and the features drawn from them.

A document's tree is one array column of the document's row: parsing is a narrow Arrow stage and
every feature below is an expression over that array, so no node is ever shuffled.
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.arrays import let, term_counts
from labelmill.functions.text import PATH_FRAGMENT_RE, WORD_RE, find_all

TREE_DDL = (
    "array<struct<node_type: string, token: string, parent: int, depth: int, n_children: int, "
    "ancestors: array<int>>>"
)
# Limits of the path contexts.
MAX_LENGTH, MAX_WIDTH, MAX_ANCESTORS = 6, 2, 12
TOKEN_CHARS = 50
DEPTH_CAP, CHILDREN_CAP = 10, 5
EMPTY_CONTEXTS, EMPTY_NODES = "empty_contexts", "empty_nodetypes"

NODES_PER_BATCH = 200_000


def parse_python(code):
    """The module node, a second time without non-ASCII characters after a syntax error; None on failure."""
    if not isinstance(code, str):
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in (code, code.encode("ascii", "ignore").decode("ascii")):
            try:
                return ast.parse(text)
            except SyntaxError:
                continue
            except (ValueError, RecursionError, MemoryError):
                return None
    return None


def node_token(node: ast.AST) -> str | None:
    """The node's own word: identifier, literal, held value, argument or definition name, operator.

    A held value that is itself a node gives that node's type name, so tokens never depend on
    object addresses.
    """
    fields = node._fields
    if isinstance(node, ast.Name):
        return node.id
    if "value" in fields:
        value = node.value
        text = type(value).__name__ if isinstance(value, ast.AST) else str(value)
        # A lone surrogate is legal in a literal but not in a column.
        return text[:TOKEN_CHARS].encode("utf-8", "replace").decode("utf-8")
    for name in ("arg", "name", "attr"):
        if name in fields:
            return getattr(node, name, None)
    return type(node.op).__name__ if "op" in fields else None


def walk_preorder(root: ast.AST):
    """(node_type, token, parent, depth, n_children, ancestors) in preorder; iterative, so depth is no limit.
    Ancestors are preorder numbers, nearest first, the node itself included."""
    stack, number = [(root, -1, 0, ())], 0
    while stack:
        node, parent, depth, above = stack.pop()
        children = list(ast.iter_child_nodes(node))
        ancestors = (number, *above[: MAX_ANCESTORS - 1])
        yield type(node).__name__, node_token(node), parent, depth, len(children), ancestors
        stack.extend((c, number, depth + 1, ancestors) for c in reversed(children))
        number += 1


class _TreeBatch:
    """Collects the trees of some rows as flat Arrow columns."""

    def __init__(self) -> None:
        self.offsets: list[int | None] = []
        self.flat: list[list] = [[] for _ in range(5)]
        self.anc: list[int] = []
        self.anc_offsets: list[int] = [0]

    def add(self, code) -> None:
        root = parse_python(code)
        try:
            nodes = None if root is None else list(walk_preorder(root))
        except ValueError:  # a literal too long to print
            nodes = None
        self.offsets.append(None if nodes is None else len(self.flat[0]))
        for *scalars, ancestors in nodes or ():
            for column, value in zip(self.flat, scalars):
                column.append(value)
            self.anc.extend(ancestors)
            self.anc_offsets.append(len(self.anc))

    def array(self) -> pa.Array:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        columns = [pa.array(c, k) for c, k in zip(self.flat, kinds)]
        columns.append(pa.ListArray.from_arrays(pa.array(self.anc_offsets, pa.int32()), pa.array(self.anc, pa.int32())))
        nodes = pa.StructArray.from_arrays(
            columns, names=["node_type", "token", "parent", "depth", "n_children", "ancestors"]
        )
        return pa.ListArray.from_arrays(pa.array([*self.offsets, len(nodes)], pa.int32()), nodes)


def parse_trees(df: DataFrame, code: str, *keep: str) -> DataFrame:
    """(keep..., tree): the Python syntax tree of ``code``, null when it does not parse.

    Output batches are cut by node count, so a worker's memory is bounded by its largest single
    document and not by the number of rows in a batch.
    """
    source = df.select(*keep, code)
    schema = f"struct<{', '.join([*_ddl(df.select(*keep)), f'tree: {TREE_DDL}'])}>"

    def run(batches):
        for batch in batches:
            texts, start, trees = batch.column(batch.num_columns - 1), 0, _TreeBatch()
            for i in range(batch.num_rows):
                trees.add(texts[i].as_py())
                if len(trees.flat[0]) >= NODES_PER_BATCH or i + 1 == batch.num_rows:
                    kept = [batch.column(c).slice(start, i + 1 - start) for c in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*kept, trees.array()], names=[*keep, "tree"])
                    start, trees = i + 1, _TreeBatch()

    return source.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> list[str]:
    return [f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields]


def explode_nodes(trees: DataFrame, *keep: str) -> DataFrame:
    """Nodes table (keep..., preorder, parent, depth, node_type, token, n_children)."""
    return trees.select(*keep, F.posexplode("tree").alias("preorder", "_n")).select(
        *keep, "preorder", "_n.parent", "_n.depth", "_n.node_type", "_n.token", "_n.n_children"
    )


def structural_keys(tree: Column) -> Column:
    """Three keys per node: its type, its capped depth, its capped number of children."""
    return F.flatten(F.transform(tree, lambda n: F.array(
        F.concat(F.lit("node_type_"), n["node_type"]),
        F.concat(F.lit("depth_level_"), F.least(n["depth"], F.lit(DEPTH_CAP)).cast("string")),
        F.concat(F.lit("children_count_"), F.least(n["n_children"], F.lit(CHILDREN_CAP)).cast("string")),
    )))


def structural_counts(trees: DataFrame, *keep: str) -> DataFrame:
    """(keep..., term, cnt); a document without a tree has no rows."""
    counts = F.explode(term_counts(structural_keys(F.col("tree")))).alias("_t")
    return trees.select(*keep, counts).select(*keep, "_t.term", "_t.cnt")


def path_contexts(tree: Column, max_length: int = MAX_LENGTH, max_width: int = MAX_WIDTH) -> Column:
    """array<struct<start_token, path, end_token>> for each node and the next ``max_width`` in preorder.

    The lowest common ancestor is the first ancestor of the later node that is also one of the
    earlier.  The path goes up from the earlier node and down to the later one and leaves the
    common ancestor out; paths of more than ``max_length`` steps are dropped.
    """

    def word(n: Column) -> Column:
        return F.coalesce(F.nullif(n["token"], F.lit("")), n["node_type"])

    def pair(nodes: Column, a: Column, b: Column) -> Column:
        def climb(lca: Column) -> Column:
            up = F.slice(a["ancestors"], F.lit(1), F.array_position(a["ancestors"], lca).cast("int") - 1)
            down = F.slice(b["ancestors"], F.lit(1), F.array_position(b["ancestors"], lca).cast("int") - 1)
            steps = F.concat(
                F.transform(up, lambda k: F.concat(F.get(nodes, k)["node_type"], F.lit("↑"))),
                F.transform(F.reverse(down), lambda k: F.concat(F.lit("↓"), F.get(nodes, k)["node_type"])),
            )
            return let(steps, lambda s: F.when(
                F.size(s).between(1, max_length),
                F.struct(word(a).alias("start_token"), F.concat_ws("→", s).alias("path"), word(b).alias("end_token")),
            ))

        shared = F.filter(b["ancestors"], lambda k: F.array_contains(a["ancestors"], k))
        return let(F.get(shared, F.lit(0)), lambda lca: F.when(lca.isNotNull(), climb(lca)))

    def over(nodes: Column) -> Column:
        near = F.transform(nodes, lambda a, i: F.transform(
            F.slice(nodes, i + 2, F.lit(max_width)), lambda b: pair(nodes, a, b)
        ))
        return F.filter(F.flatten(near), lambda c: c.isNotNull())

    return let(tree, over)


def explode_contexts(trees: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, start_token, path, end_token)."""
    return trees.select(*keep, F.posexplode(path_contexts(F.col("tree"))).alias("pos", "_c")).select(
        *keep, "pos", "_c.start_token", "_c.path", "_c.end_token"
    )


def context_text(tree: Column) -> Column:
    """Path contexts as 'start|path|end' joined by blanks, with a placeholder when there are none."""
    parts = F.transform(path_contexts(tree), lambda c: F.concat_ws("|", c["start_token"], c["path"], c["end_token"]))
    return F.coalesce(F.nullif(F.concat_ws(" ", parts), F.lit("")), F.lit(EMPTY_CONTEXTS))


def node_type_text(tree: Column) -> Column:
    """Node types in preorder joined by blanks, with a placeholder when there is no tree."""
    types = F.concat_ws(" ", F.transform(tree, lambda n: n["node_type"]))
    return F.coalesce(F.nullif(types, F.lit("")), F.lit(EMPTY_NODES))


def path_fragments(tree: Column) -> Column:
    """Tokens of the path vectoriser: the pieces of the context text between its separators."""
    return find_all(context_text(tree), PATH_FRAGMENT_RE)


def node_type_words(tree: Column) -> Column:
    return find_all(node_type_text(tree), WORD_RE)
