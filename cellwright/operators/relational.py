"""Relational operators over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def filter_by(df: DataFrame, mask: Column | str) -> DataFrame:
    """The rows where ``mask`` (a boolean column or SQL) is true."""
    return df.where(mask)


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, or all if there are fewer; after an ``orderBy``, the first in that order."""
    return df.limit(n)


def sort_asc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Ascending by one column, nulls first; equal values by ``ties``."""
    return df.orderBy(F.col(column).asc_nulls_first(), *ties)


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Descending by one column, nulls first here too."""
    return df.orderBy(F.col(column).desc_nulls_first(), *ties)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows in an order; each partition keeps ``k`` rows at most, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def group_by(df: DataFrame, base: str, *keys: str, order: str | None = None) -> DataFrame:
    """Keys with the list of their ``base`` values. A null key is a key; null values are dropped from the list.

    ``order`` names a column to sort each list by. The list of one key is one
    value, so use an aggregate instead where a key may hold a large part of the
    table.
    """
    if order is None:
        return df.groupBy(*keys).agg(F.collect_list(base).alias(base))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(base).alias("v"))))
    return df.groupBy(*keys).agg(F.filter(F.transform(pairs, lambda p: p["v"]), lambda v: v.isNotNull()).alias(base))


def aggregate(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """One row a group with the named aggregates, partly computed before the shuffle; without keys, one row."""
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in values.items()])


def join_by(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Co-group: every key of any table with the rows that have it, as one list of structs; keys without partner stay."""
    for t in tables:
        missing = [k for k in keys if k not in t.columns]
        if missing:
            raise KeyError(f"cannot find columns {missing}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("rows"))


def join_by_count(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The size of each group of ``join_by``, aggregated before the shuffle."""
    rows = reduce(lambda a, b: a.unionAll(b), [t.select(*keys) for t in tables])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def join_by_inner(left: DataFrame, right: DataFrame, keys: Sequence[str] | Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of both tables paired by equal keys; pairs of names join differently named keys."""
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    if all(a == b for a, b in pairs):
        return left.join(right, [a for a, _ in pairs])
    return left.join(right, reduce(lambda x, y: x & y, [left[a] == right[b] for a, b in pairs]))


def natural_join(left: DataFrame, right: DataFrame, common: Sequence[str] | None = None) -> DataFrame:
    """Inner join on the common columns (found by name if not given), which appear once."""
    common = list(common) if common is not None else [c for c in left.columns if c in set(right.columns)]
    if not common:
        raise ValueError("the tables have no column in common")
    return left.join(right, common)


def take(df: DataFrame, indices: DataFrame, position: str = "pos", index: str = "index") -> DataFrame:
    """The rows of ``df`` at the given values of its ``index`` column, with the place they were asked for in.

    ``indices`` has columns (position, index); an absent index gives nulls, a repeated one gives its row again.
    """
    found = df.join(indices.select(index), index, "left_semi")  # filters the table before it is shuffled
    return indices.join(found, index, "left").orderBy(position)


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def make_source(spark: SparkSession, values: Iterable, schema: str = "v long") -> DataFrame:
    """A table of literal values or rows."""
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def repeat(spark: SparkSession, value, n: int, type_name: str = "bigint") -> DataFrame:
    """``n`` rows of one value. ``streaming.sources.repeat_stream`` has no end."""
    return spark.range(n).select(F.lit(value).cast(type_name).alias("v"))


def to_vec(df: DataFrame, column: str, type_name: str) -> DataFrame:
    """One column as a vector of one type; values of other types become null."""
    c = F.col(column)
    kind = dict(df.dtypes)[column]
    return df.select((F.try_variant_get(c, "$", type_name) if kind == "variant" else c.try_cast(type_name)).alias(column))
