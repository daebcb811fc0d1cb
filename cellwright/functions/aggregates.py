"""Aggregates. Nulls are skipped; an empty or all-null input gives NULL, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.functions.scalar import col


def count(_: Column | str | None = None) -> Column:
    """Rows, nulls included."""
    return F.count(F.lit(1))


def sum(x: Column | str) -> Column:  # noqa: A001
    return F.sum(col(x))


def sum_same_type(x: Column | str, type_name: str) -> Column:
    """The sum in the input's own type; it fails if that overflows."""
    return F.sum(col(x)).cast(type_name)


def max(x: Column | str) -> Column:  # noqa: A001
    """Of booleans: whether any is true."""
    return F.max(col(x))


def min(x: Column | str) -> Column:  # noqa: A001
    """Of booleans: whether all are true."""
    return F.min(col(x))


def all(x: Column | str) -> Column:  # noqa: A001
    return F.bool_and(col(x))


def any(x: Column | str) -> Column:  # noqa: A001
    return F.bool_or(col(x))


def avg(x: Column | str) -> Column:
    return F.avg(col(x))


def avg_all_rows(x: Column | str) -> Column:
    """The sum over the number of all rows, those with nulls too."""
    return F.sum(col(x)) / F.count(F.lit(1))


def avg_partial(x: Column | str) -> Column:
    """A partial average: the sum and the number of all rows."""
    return F.struct(F.sum(col(x)).alias("s"), F.count(F.lit(1)).alias("c"))


def avg_merge(partial: Column | str) -> Column:
    """Partial averages, merged."""
    p = col(partial)
    return F.struct(F.sum(p["s"]).alias("s"), F.sum(p["c"]).alias("c"))


def avg_final(partial: Column | str) -> Column:
    return col(partial)["s"] / col(partial)["c"]
