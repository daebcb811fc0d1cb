"""Scans and lookups over a table with an id column.

Filters apply before projections, rows whose filter is not true are dropped, and
every row is returned once. Orders are total: by value, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cellwright.plans.expr import compile_expr

#: Lookup keys up to which the keys are broadcast; they come from the caller's memory.
BROADCAST_KEYS = 100_000
#: Keys up to which a lookup is a filter on the scan.
PUSHED_KEYS = 1_000


class Ordering(Enum):
    FORWARD = "forward"
    BACKWARD = "backward"


class Bound(Enum):
    INCLUSIVE = "inclusive"
    EXCLUSIVE = "exclusive"
    OPEN = "open"


@dataclass(frozen=True)
class Term:
    """One end of a range."""

    bound: Bound
    value: Any = None


def inclusive(value: Any) -> Term:
    return Term(Bound.INCLUSIVE, value)


def exclusive(value: Any) -> Term:
    return Term(Bound.EXCLUSIVE, value)


OPEN = Term(Bound.OPEN)


@dataclass(frozen=True)
class ValueRange:
    start: Term = OPEN
    end: Term = OPEN

    def predicate(self, column: Column) -> Column:
        """Whether a value lies in the range; a null value lies in none. Ends are cast to nothing: they keep pushed-down forms."""
        out = column.isNotNull()
        if self.start.bound is not Bound.OPEN:
            out = out & (column >= self.start.value if self.start.bound is Bound.INCLUSIVE else column > self.start.value)
        if self.end.bound is not Bound.OPEN:
            out = out & (column <= self.end.value if self.end.bound is Bound.INCLUSIVE else column < self.end.value)
        return out


def project(df: DataFrame, projection: Sequence[str] = ()) -> DataFrame:
    """The named columns or dotted paths, each under its last name; all columns if none is named."""
    if not projection:
        return df
    names = [p.rsplit(".", 1)[-1] for p in projection]
    clash = {n for n in names if names.count(n) > 1}
    return df.select(*[F.col(p).alias(p.replace(".", "_") if n in clash else n) for p, n in zip(projection, names)])


def _order(df: DataFrame, ordering: Ordering | None, *columns: str) -> DataFrame:
    if ordering is None:
        return df
    return df.orderBy(*[F.col(c).asc() if ordering is Ordering.FORWARD else F.col(c).desc() for c in columns])


def _finish(df: DataFrame, id_col: str, projection: Sequence[str], selection: str | Column | None, processing: str | Column | None, ordering: Ordering | None, *order: str) -> DataFrame:
    if selection is not None:
        df = df.where(compile_expr(selection, df.columns))
    df = _order(df, ordering, *order)
    if processing is not None:
        return df.select(id_col, compile_expr(processing, df.columns).alias("value"))
    return project(df, projection)


def scan_all(df: DataFrame, id_col: str, projection: Sequence[str] = (), selection: str | Column | None = None, processing: str | Column | None = None, ordering: Ordering | None = None) -> DataFrame:
    """Every row, filtered by ``selection``, with ``processing`` as its value or else the projected columns.

    Ordered by id if an ordering is asked for; the order is a full sort over range partitions.
    """
    return _finish(df, id_col, projection, selection, processing, ordering, id_col)


def range_index_scan(df: DataFrame, id_col: str, field: str, value_range: ValueRange, projection: Sequence[str] = (), selection: str | Column | None = None, processing: str | Column | None = None, ordering: Ordering | None = None) -> DataFrame:
    """The rows whose ``field`` lies in the range, in (value, id) order if asked for. The bounds reach the file scan."""
    return _finish(df.where(value_range.predicate(F.col(field))), id_col, projection, selection, processing, ordering, field, id_col)


def array_index_scan(df: DataFrame, field: str, value_range: ValueRange) -> DataFrame:
    """The rows with any element of an array field in the range, each row once."""
    return df.where(F.exists(field, value_range.predicate))


def hash_index_lookup(df: DataFrame, field: str, value: Any) -> DataFrame:
    return df.where(F.col(field) == F.lit(value))


def read_cell(df: DataFrame, id_col: str, key: Any) -> DataFrame:
    """The row with the key, or none."""
    return df.where(F.col(id_col) == F.lit(key)).limit(1)


def _found(df: DataFrame, id_col: str, keys: Sequence[Any], wanted: DataFrame) -> DataFrame:
    """The rows with any of the keys: a filter that reaches the files if the keys are few, else a join that broadcasts them if it can."""
    if len(keys) <= PUSHED_KEYS:
        return df.where(F.col(id_col).isin(list(dict.fromkeys(keys))))
    distinct = wanted.select(id_col).distinct()
    return df.join(F.broadcast(distinct) if len(keys) <= BROADCAST_KEYS else distinct, id_col, "left_semi")


def read_all_cells(df: DataFrame, id_col: str, keys: Sequence[Any], columns: Sequence[str] = (), selection: str | Column | None = None, processing: str | Column | None = None) -> DataFrame:
    """A row for each key, with its place ``pos`` in ``keys``; what isn't found (or fails ``selection``) has nulls. A repeated key repeats its row."""
    if selection is not None:
        df = df.where(compile_expr(selection, df.columns))
    if processing is not None:
        df = df.select(id_col, compile_expr(processing, df.columns).alias("value"))
    elif columns:
        df = df.select(id_col, *[F.col(c).alias(c.rsplit(".", 1)[-1]) for c in columns if c != id_col])
    kind = df.schema[id_col].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos int, `{id_col}` {kind}")
    return wanted.join(_found(df, id_col, keys, wanted), id_col, "left").select("pos", *df.columns)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def seek(df: DataFrame, key: str, id_col: str, value_range: ValueRange = ValueRange(), ordering: Ordering = Ordering.FORWARD, block: int = 64, after: tuple[Any, Any] | None = None) -> DataFrame:
    """One block of an ordered scan; ``after`` is the (key, id) of the last row seen. Only ``block`` rows leave each partition."""
    df = df.where(value_range.predicate(F.col(key)))
    if after is not None:
        k, i = F.col(key), F.col(id_col)
        df = df.where((k > after[0]) | ((k == after[0]) & (i > after[1])) if ordering is Ordering.FORWARD else (k < after[0]) | ((k == after[0]) & (i < after[1])))
    return _order(df, ordering, key, id_col).limit(block)


class DataCursor:
    """Iterates a result's rows, one partition in memory at a time."""

    def __init__(self, df: DataFrame, block: int = 64):
        self.columns, self._rows, self.block = df.columns, df.toLocalIterator(prefetchPartitions=True), block

    def __iter__(self) -> Iterator[Row]:
        return self._rows

    def next(self) -> Row | None:
        return next(self._rows, None)

    def next_block(self) -> list[Row]:
        out: list[Row] = []
        while len(out) < self.block and (row := self.next()) is not None:
            out.append(row)
        return out


class IdCursor:
    """Walks the ids of a table in (key, id) order, a block at a time, from any place.

    A block is fetched when it is needed, by ``seek`` behind the last row seen, so
    a cursor holds one block and may be resumed elsewhere from its ``position``.
    """

    def __init__(self, df: DataFrame, key: str, id_col: str, value_range: ValueRange = ValueRange(), ordering: Ordering = Ordering.FORWARD, block: int = 64, position: tuple[Any, Any] | None = None):
        self._df, self._key, self._id = df.select(*dict.fromkeys((key, id_col))), key, id_col
        self._range, self._ordering, self.block = value_range, ordering, block
        self._rows: list[Row] = []
        self._at = 0
        self._fetch(position)

    def _fetch(self, after: tuple[Any, Any] | None) -> None:
        self._rows, self._at = seek(self._df, self._key, self._id, self._range, self._ordering, self.block, after).collect(), 0
        self._after = after

    @property
    def position(self) -> tuple[Any, Any] | None:
        """(key, id) of the row before the current one: a cursor made with it starts at the current row."""
        return self._after if self._at == 0 else (self._rows[self._at - 1][self._key], self._rows[self._at - 1][self._id])

    def current(self) -> Any | None:
        """The id under the cursor, or None behind the end."""
        return self._rows[self._at][self._id] if self._at < len(self._rows) else None

    def current_block(self) -> list[Any]:
        """The ids from the cursor to the end of the fetched block."""
        return [r[self._id] for r in self._rows[self._at:]]

    def next(self) -> bool:
        """Move on by one; False behind the end."""
        if self._at < len(self._rows):
            self._at += 1
            if self._at == self.block:
                self._fetch((self._rows[-1][self._key], self._rows[-1][self._id]))
        return self._at < len(self._rows)

    def next_block(self) -> list[Any]:
        """The rest of the block, and move behind it."""
        out = self.current_block()
        if len(self._rows) == self.block:
            self._fetch((self._rows[-1][self._key], self._rows[-1][self._id]))
        else:
            self._at = len(self._rows)
        return out


def merge_runs(runs: Sequence[DataFrame], key: Sequence[str], deleted: DataFrame | None = None, ordering: Ordering = Ordering.FORWARD) -> DataFrame:
    """Several runs as one ordered result without the deleted keys."""
    from cellwright.operators.relational import concat

    df = concat(*runs)
    if deleted is not None:
        df = df.join(deleted, list(key), "left_anti")
    return _order(df, ordering, *key)
