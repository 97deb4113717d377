"""Fixed vocabularies.  These values are part of the data contract."""

from __future__ import annotations

# Label code in the wide matrix -> long label name, in matrix column order.
LABEL_NAMES = {
    "Warm": "warm_up",
    "Gram": "grammar_parsing",
    "Str": "string_manipulation",
    "Math": "mathematical",
    "Sptl": "spatial",
    "Img": "image_processing",
    "Cell": "cellular_automata",
    "Grid": "grid_traversal",
    "Grph": "graph_algorithms",
    "Path": "pathfinding",
    "BFS": "breadth_first_search",
    "DFS": "depth_first_search",
    "Dyn": "dynamic_programming",
    "Memo": "memoization",
    "Opt": "optimization",
    "Log": "logarithmic",
    "Bit": "bit_manipulation",
    "VM": "virtual_machine",
    "Rev": "reverse_engineering",
    "Sim": "simulation",
    "Inp": "input_parsing",
    "Scal": "scaling",
}

LABEL_CODES = list(LABEL_NAMES)
LABELS = list(LABEL_NAMES.values())

# Columns of the label matrix before the mark columns, as Spark DDL.
MATRIX_HEAD_DDL = (
    "Year int, Day int, Title string, Cmnts int, Thread string, P1Desc int, P2Desc int, "
    "P1Lead string, P2Lead string, P1LOC int, P2LOC int"
)

# Source tags of the labelled samples.
SOURCES = ["leaderboard", "reddit", "github"]

FIRST_YEAR, LAST_YEAR = 2015, 2023
FIRST_DAY, LAST_DAY = 1, 25
