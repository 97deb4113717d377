"""Row-local array expressions.  None of them shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected expression into a lambda that runs per element; binding
    it as a lambda variable guarantees one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def string_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def sql_strings(values: Iterable[str]) -> str:
    """``string_array`` as SQL text, for expressions that are clearer in SQL."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return f"cast(array({quoted}) as array<string>)"


def term_counts(tokens: Column) -> Column:
    """array<string> -> array<struct<term,cnt>> sorted by term, as run lengths of the sorted array.

    A document is one row, so counting its tokens in place needs no shuffle at all; an
    explode + groupBy(doc, term) would send every (doc, term) pair over the network.
    """

    def runs(s: Column) -> Column:
        # Nulls sort first and never differ from what precedes them, so they start no run.
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1))
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda i, j: F.struct(
                    F.get(s, i).alias("term"),
                    (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("bigint").alias("cnt"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Scale to unit L2 norm; the norm is clamped from below so that a zero vector stays zero."""
    return let(
        F.struct(v.alias("v"), F.greatest(l2_norm(v), F.lit(eps)).alias("norm")),
        lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["norm"]),
    )


def masked_mean(vectors: Column, mask: Column, eps: float = 1e-9) -> Column:
    """Mean of the unmasked vectors of one sequence: sum(v * m) / max(sum(m), eps), per dimension."""
    width = F.size(F.get(vectors, F.lit(0)))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(
        weighted,
        F.array_repeat(F.lit(0.0), width),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
    )
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(eps))
    return let(weight, lambda w: F.transform(total, lambda x: x / w))
