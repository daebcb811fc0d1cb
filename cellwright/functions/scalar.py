"""Scalar functions over columns.

The plain names follow SQL: three-valued logic, NULL in and NULL out. Names that
end in ``_strict`` keep another, deliberate rule, given in their docstrings.
Functions of many arguments fold from the left; with one they return it.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str, path: str | None = None, type_name: str = "string") -> Column:
    """A column; with ``path``, a value inside its variant as a type, null if it isn't there or isn't of the type."""
    c = F.col(c) if isinstance(c, str) else c
    return c if path is None else F.try_variant_get(c, path, type_name)


def dynamic(c: Column | str) -> Column:
    """JSON text as a variant, null if it isn't JSON."""
    return F.try_parse_json(col(c))


def _fold(op: Callable[[Column, Column], Column], args: tuple[Column | str, ...]) -> Column:
    if not args:
        raise ValueError("at least one argument is needed")
    return reduce(op, map(col, args))


# boolean

def and_(*args: Column | str) -> Column:
    return _fold(operator.and_, args)


def or_(*args: Column | str) -> Column:
    return _fold(operator.or_, args)


def _both(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.when(x.isNotNull() & y.isNotNull(), op(x, y))


def and_strict(*args: Column | str) -> Column:
    """NULL if any side is NULL, even beside false."""
    return _fold(_both(operator.and_), args)


def or_strict(*args: Column | str) -> Column:
    """NULL if any side is NULL, even beside true."""
    return _fold(_both(operator.or_), args)


def not_(x: Column | str) -> Column:
    return ~col(x)


def and_not(x: Column | str, y: Column | str) -> Column:
    return col(x) & ~col(y)


def and_not_strict(x: Column | str, y: Column | str) -> Column:
    return and_strict(x, ~col(y))


def xor(x: Column | str, y: Column | str) -> Column:
    return col(x) != col(y)


def is_null(x: Column | str) -> Column:
    return col(x).isNull()


def is_not_null(x: Column | str) -> Column:
    return col(x).isNotNull()


def null_if(x: Column | str, mask: Column | str) -> Column:
    """``x``, or NULL where the boolean ``mask`` is true (not SQL's two-value NULLIF)."""
    return F.when(~F.coalesce(col(mask), F.lit(False)), col(x))


# comparison

def _compare(op: Callable[[Column, Column], Column]) -> Callable[[Column | str, Column | str], Column]:
    return lambda x, y: op(col(x), y if isinstance(y, Column) else col(y) if isinstance(y, str) else F.lit(y))


eq, not_eq = _compare(operator.eq), _compare(operator.ne)
gt, gt_eq, lt, lt_eq = _compare(operator.gt), _compare(operator.ge), _compare(operator.lt), _compare(operator.le)


def like(x: Column | str, pattern: str | Column) -> Column:
    """SQL LIKE, case-sensitive; a string is a pattern, not a column name."""
    return F.like(col(x), F.lit(pattern) if isinstance(pattern, str) else pattern)


def not_like(x: Column | str, pattern: str | Column) -> Column:
    return ~like(x, pattern)


# numeric

def add(*args: Column | str) -> Column:
    return _fold(operator.add, args)


def subtract(*args: Column | str) -> Column:
    return _fold(operator.sub, args)


def multiply(*args: Column | str) -> Column:
    return _fold(operator.mul, args)


def divide(*args: Column | str) -> Column:
    """Division of fractions."""
    return _fold(operator.truediv, args)


def divide_int(*args: Column | str) -> Column:
    """Division of integers, truncated towards zero."""
    return _fold(lambda x, y: F.call_function("div", x, y), args)


def negate(x: Column | str) -> Column:
    return -col(x)


def rem(x: Column | str, y: Column | str) -> Column:
    return col(x) % col(y)


def try_add(*args: Column | str) -> Column:
    """Like ``add``, with NULL where the type overflows."""
    return _fold(F.try_add, args)


def try_divide(*args: Column | str) -> Column:
    """Like ``divide``, with NULL for division by zero."""
    return _fold(F.try_divide, args)


# strings, sets and casts

def string_matches(x: Column | str, regex: str) -> Column:
    return col(x).rlike(regex)


def index_in(x: Column | str, values: list) -> Column:
    """Position from 0 of the value in the list, NULL if absent."""
    at = F.array_position(F.array(*map(F.lit, values)), col(x))
    return F.when(at > 0, at - 1)


def is_in(x: Column | str, values: list) -> Column:
    return col(x).isin(values)


def string_is_decimal(x: Column | str) -> Column:
    return col(x).rlike(r"^\p{Nd}+$")


def string_is_digit(x: Column | str) -> Column:
    return col(x).rlike("^[0-9]+$")


def string_is_numeric(x: Column | str) -> Column:
    return col(x).rlike(r"^\p{N}+$")


def string_is_space(x: Column | str) -> Column:
    return col(x).rlike(r"^\s+$")


def string_is_lower_case(x: Column | str) -> Column:
    return (col(x) == F.lower(col(x))) & col(x).rlike(r"\p{Ll}")


def string_is_upper_case(x: Column | str) -> Column:
    return (col(x) == F.upper(col(x))) & col(x).rlike(r"\p{Lu}")


def substring(x: Column | str, start: int, length: int) -> Column:
    """``length`` characters from position ``start``, counted from 1."""
    return F.substring(col(x), start, length)


def string_to_upper(x: Column | str) -> Column:
    return F.upper(col(x))


def string_to_lower(x: Column | str) -> Column:
    return F.lower(col(x))


def string_length(x: Column | str) -> Column:
    """Length in characters."""
    return F.length(col(x))


def concat(*args: Column | str) -> Column:
    return F.concat(*map(col, args))


def cast(x: Column | str, type_name: str) -> Column:
    return col(x).cast(_type(type_name))


def try_cast(x: Column | str, type_name: str) -> Column:
    return col(x).try_cast(_type(type_name))


def can_cast(x: Column | str, type_name: str) -> Column:
    """Whether the cast gives a value; NULL can always be cast."""
    return col(x).isNull() | try_cast(x, type_name).isNotNull()


def _type(name: str):
    from cellwright.types import TYPES

    return TYPES.get(name, name)


# values of maps

def get_in(x: Column | str, path: list[str]) -> Column:
    return reduce(lambda c, name: c.getField(name), path, col(x))


def set_in(x: Column | str, path: list[str], value: Column) -> Column:
    """The map with the value at ``path`` replaced; maps on the way must exist."""
    return update_in(x, path, lambda _: value)


def update_in(x: Column | str, path: list[str], f: Callable[[Column], Column]) -> Column:
    c = col(x)
    if len(path) == 1:
        return c.withField(path[0], f(c.getField(path[0])))
    return c.withField(path[0], update_in(c.getField(path[0]), path[1:], f))
