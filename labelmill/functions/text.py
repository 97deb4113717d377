"""Regex and string expressions with Python's text semantics, evaluated on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.functions.arrays import let, term_counts

# The characters Python's str.split / str.strip / re's \s call white space.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
SPACE_RE = f"[{SPACE}]"
NON_SPACE_RE = f"[^{SPACE}]"

# Token patterns.  Python's \w is [letters, numbers, underscore] of Unicode.
CODE_TOKEN_RE = r"[\p{L}\p{N}_]+|[+\-*/=<>!&|]+|[(){}\[\];,.]"
TFIDF_TOKEN_RE = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+|==|!=|<=|>=|[-+*/%=(){}\[\]:.,]"
WORD_RE = r"[\p{L}\p{N}_]+"
PATH_FRAGMENT_RE = r"[^|→↑↓]+"
IMPORT_LINE_RE = rf"(?md)^{SPACE_RE}*(import|from){SPACE_RE}+[^\n]+"
RANK_LINE_RE = (
    rf"(?i)\[(?:language|lang):{SPACE_RE}*[^\]]+\]{SPACE_RE}*"
    rf"(?:\b([1-9][0-9]?|100)\b{SPACE_RE}*/{SPACE_RE}*\p{{Nd}}{{1,4}}"
    rf"|\p{{Nd}}{{1,4}}{SPACE_RE}*/{SPACE_RE}*\b([1-9][0-9]?|100)\b)"
)


def strip_space(text: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.regexp_replace(text, rf"\A{SPACE_RE}+|{SPACE_RE}+\z", "")


def is_blank(text: Column) -> Column:
    """True for text that ``strip_space`` would empty; null stays null."""
    return ~text.rlike(NON_SPACE_RE)


def is_nonblank(text: Column) -> Column:
    """Not null and not only white space; never null, so it is safe in a filter or a negation."""
    return F.coalesce(text.rlike(NON_SPACE_RE), F.lit(False))


def strip_imports(code: Column) -> Column:
    """Remove import lines.  White space before them, blank lines included, goes with them;
    continuation lines of a parenthesised import stay."""
    return F.regexp_replace(code, IMPORT_LINE_RE, "")


def truncate_snippet(text: Column, n: int = 80) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Identifiers and numbers, operator runs, single brackets and separators; null text has no tokens."""
    return find_all(F.coalesce(text, F.lit("")), CODE_TOKEN_RE)


def tfidf_tokens(text: Column) -> Column:
    return find_all(F.coalesce(text, F.lit("")), TFIDF_TOKEN_RE)


def space_tokens(text: Column) -> Column:
    """Python's ``str.split()``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_RE}+"), lambda t: t != "")


def token_ngrams(tokens: Column, n: int = 3) -> Column:
    """All contiguous n-tuples as array<array<string>>; none when there are fewer than n tokens."""
    return let(
        tokens,
        lambda t: F.transform(
            F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))),
            lambda x, i: F.array(x, *[F.get(t, i + k) for k in range(1, n)]),
        ),
    )


def _each_ngram(tokens: Column, n: int, body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of the tokens of every contiguous n-tuple."""
    return let(
        tokens,
        lambda t: F.transform(
            F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))),
            lambda x, i: body([x, *[F.get(t, i + k) for k in range(1, n)]]),
        ),
    )


def ngram_strings(tokens: Column, n: int = 3, sep: str = " ") -> Column:
    """The n-grams as joined strings, for counting."""
    return _each_ngram(tokens, n, lambda parts: F.concat_ws(sep, *parts))


def ngram_buckets(tokens: Column, group: Column, buckets: int, n: int = 3) -> Column:
    """The hash bucket of every n-gram within ``group``."""
    return _each_ngram(tokens, n, lambda parts: F.pmod(F.xxhash64(group, *parts), F.lit(buckets)).cast("int"))


def ngrams_in_buckets(tokens: Column, group: Column, buckets: int, wanted: list[int], n: int = 3, sep: str = " ") -> Column:
    """The n-grams of the ``wanted`` buckets as joined strings; others are never built."""
    def kept(parts: list[Column]) -> Column:
        bucket = F.pmod(F.xxhash64(group, *parts), F.lit(buckets)).cast("int")
        return F.when(bucket.isin(wanted), F.concat_ws(sep, *parts))

    return F.array_compact(_each_ngram(tokens, n, kept))


def doc_tf_l2(tokens: Column) -> Column:
    """Single-document TF-IDF: idf is 1, so the weights are L2-normalised counts.
    Returns array<struct<term,weight>>, empty when there are no tokens."""
    return let(
        term_counts(tokens),
        lambda counts: let(
            F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c["cnt"] * c["cnt"]).cast("double"))),
            lambda norm: F.transform(
                counts, lambda c: F.struct(c["term"].alias("term"), (c["cnt"] / norm).alias("weight"))
            ),
        ),
    )
