"""One handle for schemas, record tables, scans and transactions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from cellwright.operators import scan, stats
from cellwright.operators.kv import RecordTable
from cellwright.operators.txn import Transaction, transaction
from cellwright.registry import SchemaRegistry
from cellwright.types import IndexKind, Schema


class Client:
    """A group of tables under one folder. Groups share nothing, so two may use the same names."""

    def __init__(self, spark: SparkSession, folder: str, registry: SchemaRegistry | None = None):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), registry or SchemaRegistry()

    def new_schema(self, schema: Schema, schema_id: int | None = None) -> int:
        return self.schemas.new_schema(schema) if schema_id is None else self.schemas.new_schema_with_id(schema, schema_id)

    def del_schema(self, name: str) -> None:
        self.schemas.del_schema(name)

    def get_all_schema(self) -> list[Schema]:
        return self.schemas.get_all()

    def table(self, name: str) -> RecordTable:
        schema = self.schemas.get(name)
        if schema.key is None or "." in schema.key:
            raise ValueError(f"{name} has no top-level key")
        return RecordTable(self.spark, f"{self.folder}/{schema.id}", schema.struct(), schema.key)

    def write(self, name: str, df: DataFrame) -> int:
        return self.table(name).insert(self.schemas.get(name).check(df))

    def update(self, name: str, df: DataFrame) -> int:
        return self.table(name).update(self.schemas.get(name).check(df))

    def upsert(self, name: str, df: DataFrame) -> int:
        return self.table(name).upsert(self.schemas.get(name).check(df))

    def remove(self, name: str, keys: DataFrame) -> int:
        return self.table(name).remove(keys)

    def count(self, name: str) -> int:
        return self.table(name).count()

    def scan_all(self, name: str, projection: Sequence[str] = (), selection: str | Column | None = None, processing: str | Column | None = None, ordering: scan.Ordering | None = scan.Ordering.FORWARD) -> DataFrame:
        schema = self.schemas.get(name)
        if not schema.is_scannable:
            raise ValueError(f"{name} is not scannable")
        return scan.scan_all(self.table(name).current(), schema.key, projection, selection, processing, ordering)

    def range_index_scan(self, name: str, field: str, value_range: scan.ValueRange, projection: Sequence[str] = (), selection: str | Column | None = None, processing: str | Column | None = None, ordering: scan.Ordering | None = scan.Ordering.FORWARD) -> DataFrame:
        schema = self.schemas.get(name)
        if IndexKind.RANGED not in schema.field(field).indices:
            raise ValueError(f"{name}.{field} has no ranged index")
        return scan.range_index_scan(self.table(name).current(), schema.key, field, value_range, projection, selection, processing, ordering)

    def statistics(self, name: str) -> stats.SchemaStatistics:
        """Histograms of the fields with a ranged or a statistics index."""
        schema = self.schemas.get(name)
        return stats.schema_statistics(self.table(name).current(), schema.indexed(IndexKind.RANGED, IndexKind.STATISTICS), schema)

    def transaction(self, name: str, run: Callable[[Transaction], object], attempts: int = 1000):
        return transaction(self.table(name), run, attempts)
