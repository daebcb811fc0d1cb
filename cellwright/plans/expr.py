"""Expressions: s-expressions and SQL strings to columns.

``(and (>= a 10u64) (< a 100))`` calls registered functions and type names (as
casts) on columns; nested fields are written ``sub.field``; ``data`` is the whole
row, as a struct, in operators that bind it (``compile_expr`` with the row's
columns) and that have no column of this name. A literal may carry a type suffix. A string that doesn't start with a parenthesis is Spark SQL.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.functions.registry import Kind, function
from cellwright.types import TYPES

_TOKEN = re.compile(r"""\s*(?:(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()"]+))""")
_NUMBER = re.compile(r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(i8|i16|i32|i64|u8|u16|u32|u64|f32|f64)?")
#: Operators whose arguments after the first are plain values, not columns.
_LITERAL_TAILS = {"like", "not-like", "matches", "in", "index-in", "cast", "can-cast", "substring"}


class ExpressionError(ValueError):
    pass


class Text(str):
    """A quoted string."""


def parse(text: str):
    """Nested lists of symbols (str), quoted strings (Text), numbers (tuples of digits and suffix)."""
    stack: list[list] = [[]]
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise ExpressionError("unexpected )")
            done = stack.pop()
            stack[-1].append(done)
        elif m[3] is not None:
            stack[-1].append(Text(re.sub(r"\\(.)", r"\1", m[3])))
        else:
            n = _NUMBER.fullmatch(m[4])
            stack[-1].append((n[1], n[2]) if n else m[4])
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ExpressionError(f"unbalanced or empty expression: {text!r}")
    return stack[0][0]


def _plain(node):
    """A literal's Python value."""
    if isinstance(node, tuple):
        return float(node[0]) if re.search(r"[.eE]", node[0]) or (node[1] or "").startswith("f") else int(node[0])
    if isinstance(node, Text):
        return str(node)
    if isinstance(node, list):
        return [_plain(x) for x in node]
    return {"true": True, "false": False, "null": None}.get(node, node)


def column(node) -> Column:
    """The column that a parsed expression stands for."""
    if isinstance(node, Column):
        return node
    if isinstance(node, tuple):
        return F.lit(_plain(node)).cast(TYPES[node[1]]) if node[1] else F.lit(_plain(node))
    if isinstance(node, Text):
        return F.lit(str(node))
    if isinstance(node, str):
        if node in ("true", "false", "null"):
            return F.lit(_plain(node))
        return reduce(lambda c, name: c.getField(name), node.split(".")[1:], F.col(f"`{node.split('.')[0]}`"))
    if not node or type(node[0]) is not str:
        raise ExpressionError(f"no operator in {node!r}")
    name, args = node[0], node[1:]
    if name in TYPES and name not in ("any", "null"):  # a cast
        if len(args) != 1:
            raise ExpressionError(f"{name} casts one value")
        return column(args[0]).cast(TYPES[name])
    f = function(name)
    if f.kind not in (Kind.MAP, Kind.AGGREGATE, Kind.VECTORIZE):
        raise ExpressionError(f"{name} works on tables, not in expressions")
    if name in _LITERAL_TAILS:
        return f(column(args[0]), *map(_plain, args[1:]))
    return f(*map(column, args))


def _bind_row(node, columns: list[str]):
    """``node`` with the symbol ``data`` (or ``data.field``) replaced by the row."""
    if isinstance(node, list):
        return [node[0], *[_bind_row(x, columns) for x in node[1:]]] if node else node
    if type(node) is str and node.split(".")[0] == "data":
        path = node.split(".")[1:]
        return reduce(lambda c, name: c.getField(name), path, F.struct(*[F.col(f"`{c}`") for c in columns]))
    return node


def compile_expr(text: str | Column, columns: list[str] | None = None) -> Column:
    """A column from an s-expression, a SQL string or a column. ``columns``: those of the row, for the symbol ``data``."""
    if isinstance(text, Column):
        return text
    if not text.lstrip().startswith("("):
        return F.expr(text)
    tree = parse(text)
    return column(tree if columns is None or "data" in columns else _bind_row(tree, columns))
