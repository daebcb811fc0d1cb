"""Functions by their names in expressions, with kind and number of parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from cellwright.functions import aggregates as A
from cellwright.functions import scalar as S
from cellwright.operators import relational as R


class Kind(Enum):
    MAP = "map"
    AGGREGATE = "aggregate"
    REDUCE = "reduce"
    TERRAFORM = "terraform"
    DATA_SOURCE = "data source"
    VECTORIZE = "vectorize"


@dataclass(frozen=True)
class Function:
    name: str
    kind: Kind
    builder: Callable
    params: int  # 0: any number

    def __call__(self, *args, **options):
        if self.params and len(args) != self.params:
            raise TypeError(f"{self.name} takes {self.params} arguments, not {len(args)}")
        return self.builder(*args, **options)


FUNCTIONS: dict[str, Function] = {}


def register(name: str, kind: Kind, builder: Callable, params: int = 1) -> Function:
    """Add a function under ``name``, or replace it."""
    FUNCTIONS[name] = f = Function(name, kind, builder, params)
    return f


def function(name: str) -> Function:
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name!r}")
    return FUNCTIONS[name]


for _name, _builder, _params in (
    ("and", S.and_, 0), ("or", S.or_, 0), ("not", S.not_, 1), ("and-not", S.and_not, 2), ("xor", S.xor, 2), ("null?", S.is_null, 1), ("not-null?", S.is_not_null, 1),
    ("null-if", S.null_if, 2), ("=", S.eq, 2), ("not=", S.not_eq, 2), (">", S.gt, 2), (">=", S.gt_eq, 2), ("<", S.lt, 2), ("<=", S.lt_eq, 2), ("like", S.like, 2),
    ("not-like", S.not_like, 2), ("+", S.add, 0), ("-", S.subtract, 0), ("*", S.multiply, 0), ("/", S.divide, 0), ("~", S.negate, 1), ("rem", S.rem, 2),
    ("div", S.divide_int, 0), ("and-strict", S.and_strict, 0), ("or-strict", S.or_strict, 0), ("matches", S.string_matches, 2), ("index-in", S.index_in, 2),
    ("in", S.is_in, 2), ("decimal?", S.string_is_decimal, 1), ("digit?", S.string_is_digit, 1), ("numeric?", S.string_is_numeric, 1), ("space?", S.string_is_space, 1),
    ("lower-case?", S.string_is_lower_case, 1), ("upper-case?", S.string_is_upper_case, 1), ("substring", S.substring, 3), ("upper", S.string_to_upper, 1),
    ("lower", S.string_to_lower, 1), ("length", S.string_length, 1), ("concat", S.concat, 0), ("cast", S.cast, 2), ("can-cast", S.can_cast, 2),
):
    register(_name, Kind.MAP, _builder, _params)
for _name, _builder in (("count", A.count), ("sum", A.sum), ("max", A.max), ("min", A.min), ("all", A.all), ("any", A.any), ("avg", A.avg), ("avg-all-rows", A.avg_all_rows)):
    register(_name, Kind.AGGREGATE, _builder)
register("group-by", Kind.REDUCE, R.group_by, 0)
register("join-by", Kind.REDUCE, R.join_by, 0)
register("join", Kind.REDUCE, R.natural_join, 0)
register("filter", Kind.TERRAFORM, R.filter_by, 2)
register("limit", Kind.TERRAFORM, R.limit, 2)
register("sort-asc", Kind.TERRAFORM, R.sort_asc, 0)
register("sort-desc", Kind.TERRAFORM, R.sort_desc, 0)
register("take", Kind.TERRAFORM, R.take, 0)
register("make-source", Kind.DATA_SOURCE, R.make_source, 0)
register("repeat", Kind.DATA_SOURCE, R.repeat, 0)
register("col", Kind.VECTORIZE, S.col)
register("to-vec", Kind.VECTORIZE, R.to_vec, 0)
