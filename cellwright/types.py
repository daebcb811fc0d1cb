"""Type names and record schemas.

A record schema is a ``StructType`` with a name, an id, a key path and options.
Unsigned types widen to the next signed type; 64-bit unsigned becomes
``decimal(20,0)``. Undeclared top-level fields of a dynamic schema live in one
variant column.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that holds the undeclared fields of dynamic schemas.
DYNAMIC = "_dyn"


def _point(*axes: str, of: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(a, of) for a in axes])


TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "char": T.StringType(), "string": T.StringType(),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bytes": T.BinaryType(), "small_bytes": T.BinaryType(),
    "id": _point("higher", "lower", of=T.DecimalType(20, 0)),
    "pos2d32": _point("x", "y", of=T.FloatType()), "pos2d64": _point("x", "y", of=T.DoubleType()),
    "pos3d32": _point("x", "y", "z", of=T.FloatType()), "pos3d64": _point("x", "y", "z", of=T.DoubleType()),
    "any": T.VariantType(), "null": T.NullType(),
}
#: Bytes of a value, for cost estimates; anything else counts as WIDE.
WIDTHS = {"bool": 1, "char": 4, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "u8": 1, "u16": 2, "u32": 4, "u64": 8, "f32": 4, "f64": 8, "id": 16, "pos2d32": 8, "pos2d64": 16, "pos3d32": 12, "pos3d64": 24}
WIDE = 32


def relaxed(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every level, as casts need it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(relaxed(kind.elementType), True)
    return kind


class IndexKind(Enum):
    RANGED = "ranged"
    HASHED = "hashed"
    VECTORIZED = "vectorized"
    STATISTICS = "statistics"


@dataclass(frozen=True)
class Field:
    """One field: a type name or, for maps, sub-fields; optionally an array of either."""

    name: str
    type: str = "map"
    nullable: bool = False
    is_array: bool = False
    fields: tuple[Field, ...] = ()
    indices: tuple[IndexKind, ...] = ()

    def data_type(self) -> T.DataType:
        base = T.StructType([f.struct_field() for f in self.fields]) if self.type == "map" else TYPES[self.type]
        return T.ArrayType(base, containsNull=False) if self.is_array else base

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type(), self.nullable, {"indices": [k.value for k in self.indices]} if self.indices else {})

    def width(self) -> int:
        own = sum(f.width() for f in self.fields) if self.type == "map" else WIDTHS.get(self.type, WIDE)
        return own * (WIDE if self.is_array else 1)


class SchemaMismatch(ValueError):
    """Data that a schema doesn't allow: a null where none may be, a scalar for an array, an undeclared field."""


@dataclass
class Schema:
    """A table definition. ``key`` is the dotted path of the primary key, or None for generated ids."""

    name: str
    fields: tuple[Field, ...]
    key: str | None = None
    is_dynamic: bool = False
    is_scannable: bool = True
    id: int = 0
    by_path: dict[str, Field] = dc_field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        def walk(prefix: str, fields: tuple[Field, ...]) -> None:
            for f in fields:
                self.by_path[prefix + f.name] = f
                walk(f"{prefix}{f.name}.", f.fields)

        walk("", self.fields)
        if self.key is not None and self.key not in self.by_path:
            raise SchemaMismatch(f"key {self.key!r} is no field of {self.name!r}")

    def struct(self) -> T.StructType:
        extra = [T.StructField(DYNAMIC, T.VariantType(), True)] if self.is_dynamic else []
        return T.StructType([f.struct_field() for f in self.fields] + extra)

    def field(self, path: str) -> Field:
        if path not in self.by_path:
            raise KeyError(f"{self.name} has no field {path!r}")
        return self.by_path[path]

    def indexed(self, *kinds: IndexKind) -> list[str]:
        return [p for p, f in self.by_path.items() if set(f.indices) & set(kinds or IndexKind)]

    def width(self, paths: list[str] | None = None) -> int:
        """Estimated bytes of a row, or of the named fields; unknown fields count as wide."""
        if not paths:
            return sum(f.width() for f in self.fields)
        return sum(self.by_path[p].width() if p in self.by_path else WIDE for p in paths)

    def violations(self) -> Column:
        """Array of the paths of required fields that are null in a row."""
        checks: list[Column] = []

        def walk(prefix: str, at: Column | None, fields: tuple[Field, ...], under: Column) -> None:
            for f in fields:
                c = F.col(f"`{f.name}`") if at is None else at[f.name]
                path = prefix + f.name
                if not f.nullable:
                    checks.append(F.when(under & c.isNull(), F.lit(path)))
                if f.type == "map" and not f.is_array:
                    walk(f"{path}.", c, f.fields, under & c.isNotNull())
                elif f.is_array and not f.nullable:
                    checks.append(F.when(under & F.exists(c, lambda x: x.isNull()), F.lit(f"{path}[]")))

        walk("", None, self.fields, F.lit(True))
        return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` cast to this schema. Undeclared columns go to the variant column of a dynamic schema and are refused otherwise."""
        declared = {f.name for f in self.fields}
        missing = [f.name for f in self.fields if f.name not in df.columns and not f.nullable]
        if missing:
            raise SchemaMismatch(f"{self.name}: required fields are missing: {missing}")
        extra = [c for c in df.columns if c not in declared and c != DYNAMIC]
        if extra and not self.is_dynamic:
            raise SchemaMismatch(f"{self.name}: undeclared fields: {extra}")
        cols = [(df[f"`{f.name}`"] if f.name in df.columns else F.lit(None)).cast(relaxed(f.data_type())).alias(f.name) for f in self.fields]
        if self.is_dynamic:
            if DYNAMIC in df.columns:
                cols.append(df[DYNAMIC])
            elif extra:
                present = F.to_json(F.struct(*[df[f"`{c}`"] for c in extra]))
                cols.append(F.when(present != "{}", F.try_parse_json(present)).alias(DYNAMIC))
            else:
                cols.append(F.lit(None).cast(T.VariantType()).alias(DYNAMIC))
        return df.select(*cols)

    def check(self, df: DataFrame) -> DataFrame:
        """``df``, conformed; evaluating it fails on the first row that violates the schema."""
        out = self.conform(df)
        bad = self.violations()
        first = self.fields[0].name
        message = F.concat(F.lit(f"{self.name}: null in required field "), F.array_join(bad, ", "))
        return out.withColumn(first, F.when(F.size(bad) > 0, F.raise_error(message).cast(relaxed(self.fields[0].data_type()))).otherwise(F.col(f"`{first}`")))


def record_id(schema_id: int, key: Column) -> Column:
    """128-bit id of a record: a hash of the schema's id and the key, in two halves."""
    half = lambda seed: F.xxhash64(F.lit(seed), F.lit(schema_id), key).cast("decimal(20,0)")
    return F.when(key.isNotNull(), F.struct(half(1).alias("higher"), half(2).alias("lower")))
