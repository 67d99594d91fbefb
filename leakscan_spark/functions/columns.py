"""Small column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity order, lowest first.
TIERS = ("clean", "low", "medium", "high", "critical")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain Python variable holding a Column is re-evaluated wherever it is
    used inside a higher-order function; a lambda argument is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_STRIDE = 64


def sums_before(values: Column) -> Column:
    """For each element of an integer array, the sum of the elements before it.

    Sums of whole strides are carried along once; an element adds what is left
    of its own stride. The work follows the length, not its square.
    """

    def strides(v: Column) -> Column:
        count = F.ceil(F.size(v) / _STRIDE).cast("int")
        each = F.transform(
            F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
            lambda k: F.aggregate(F.slice(v, k * _STRIDE + 1, F.lit(_STRIDE)), F.lit(0), lambda a, x: a + x),
        )
        none = F.array(F.lit(0))
        return F.aggregate(each, none, lambda done, x: F.array_append(done, F.element_at(done, -1) + x))

    def within(v: Column, carried: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            stride = F.floor(i / _STRIDE).cast("int")
            rest = F.slice(v, stride * _STRIDE + 1, i - stride * _STRIDE)
            return F.aggregate(rest, F.get(carried, stride), lambda a, x: a + x)

        return F.transform(v, one)

    return let(values, lambda v: let(strides(v), lambda carried: within(v, carried)))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def rank(severity: Column) -> Column:
    """Severity as an integer: clean 0, low 1, ... critical 4; unknown 0."""
    s = F.lower(severity)
    return F.coalesce(
        F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1),
        F.lit(0),
    )


def tier(rank_col: Column) -> Column:
    """Inverse of :func:`rank`."""
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank_col + 1)


def report_rank(severity: Column) -> Column:
    """Report order: critical 0, high 1, medium 2, low 3, anything else 4."""
    s = F.lower(severity)
    return F.coalesce(
        F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3),
        F.lit(4),
    )


def truncate(text: Column, longest: int) -> Column:
    """Cut to ``longest`` characters, the last three of them dots."""
    return F.when(F.length(text) <= longest, text).otherwise(
        F.concat(F.substring(text, 1, longest - 3), F.lit("..."))
    )


# Fixed value: the characters that count as white space at the ends of a text.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """The same rows, with ``name`` evaluated once per row.

    Spark merges projections into the filters above them, so a filter that names
    a derived column many times would derive it as often. It does not move
    filters below a generator, which here yields exactly one row per row.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(F.col(name))).alias(name))
