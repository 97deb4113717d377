"""Python source checks and repairs.  The only place where a sample's code meets the Python grammar.

Each UDF takes an Arrow batch and handles row by row, so one bad row yields null or false and
never fails a task.  The Python version of the workers decides what is valid syntax.
"""

from __future__ import annotations

import io
import re
import tokenize
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Python 2 spellings the repair knows, as (pattern, replacement).
PY2_FIXES = [
    (r"(?m)^([^\S\n]*)print[^\S\n]*$", r"\1print()"),
    (r"(?m)^([^\S\n]*)print[^\S\n]+(?!\()([^\n]*?),[^\S\n]*$", r"\1print(\2, end=' ')"),
    (r"(?m)^([^\S\n]*)print[^\S\n]+(?!\()([^\n]+?)[^\S\n]*$", r"\1print(\2)"),
    (r"\bxrange\b", "range"),
    (r"\braw_input\b", "input"),
    (r"`([^`\n]+)`", r"repr(\1)"),
    (r"<>", "!="),
]
_FIXES = [(re.compile(p), r) for p, r in PY2_FIXES]


def compiles(code) -> bool:
    if not isinstance(code, str):
        return False
    if not code.strip():
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code, "<sample>", "exec", dont_inherit=True)
        return True
    except (SyntaxError, ValueError, TypeError, OverflowError, RecursionError, MemoryError):
        return False


def modernise(code: str) -> str:
    for pattern, replacement in _FIXES:
        code = pattern.sub(replacement, code)
    return code


def repaired_or_none(code):
    if compiles(code):
        return code
    if not isinstance(code, str):
        return None
    fixed = modernise(code)
    return fixed if compiles(fixed) else None


def _removable(tokens: list[tokenize.TokenInfo]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(start, end) of every comment and of every plain string that opens a statement or starts in column 0."""
    opens = True  # the first token opens a statement
    spans = []
    for t in tokens:
        if t.type == tokenize.COMMENT or t.type == tokenize.STRING and (opens or t.start[1] == 0):
            spans.append((t.start, t.end))
        opens = t.type in (tokenize.NEWLINE, tokenize.INDENT)
    return spans


def without_comments(code):
    """Source minus comments and statement-position strings; None when it cannot be tokenised.

    The spans are cut out of the source lines; everything else, a backslash continuation included, stays as it
    is.  A string goes when it follows an indent or a logical line's end, or starts in column 0.  An f-string is
    kept in every position.
    """
    if not isinstance(code, str):
        return None
    try:
        spans = _removable(list(tokenize.generate_tokens(io.StringIO(code).readline)))
    except (tokenize.TokenError, SyntaxError, RecursionError):
        return None
    lines = io.StringIO(code).readlines()
    # From the last span to the first, so that earlier places stay valid.
    for (top, left), (bottom, right) in reversed(spans):
        lines[top - 1:bottom] = [lines[top - 1][:left] + lines[bottom - 1][right:]]
    return "".join(lines)


def _worker_udf(fn, ddl: str):
    """A pandas UDF that maps ``fn`` over the values of an Arrow batch."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([fn(v) for v in values], dtype="object", index=values.index)

    return F.pandas_udf(run, ddl)


def valid_syntax(code: Column) -> Column:
    """Compiles as Python 3?  Null is invalid, blank is valid."""
    return _worker_udf(compiles, "boolean")(code)


def repair_or_drop(code: Column) -> Column:
    """The code itself when valid, else its modernised form when that is valid, else null."""
    return _worker_udf(repaired_or_none, "string")(code)


def strip_comments(code: Column) -> Column:
    return _worker_udf(without_comments, "string")(code)
