"""The schema registry: names and ids of record schemas, with subscriptions."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwright.types import Schema


class NameExists(ValueError):
    pass


class IdExists(ValueError):
    pass


class SchemaNotFound(KeyError):
    pass


class SchemaRegistry:
    """Schemas by unique name and unique id. A failed registration leaves nothing behind."""

    def __init__(self) -> None:
        self._by_name: dict[str, Schema] = {}
        self._by_id: dict[int, str] = {}
        self._listeners: list[Callable[[str, Schema], None]] = []
        self._lock = threading.RLock()
        self._last = 0

    def next_id(self) -> int:
        """The next id that is not in use."""
        with self._lock:
            self._last += 1
            while self._last in self._by_id:
                self._last += 1
            return self._last

    def new_schema(self, schema: Schema) -> int:
        with self._lock:
            return self.new_schema_with_id(schema, self.next_id())

    def new_schema_with_id(self, schema: Schema, schema_id: int) -> int:
        with self._lock:
            if schema.name in self._by_name:
                raise NameExists(schema.name)
            if schema_id in self._by_id:
                raise IdExists(schema_id)
            schema.id = schema_id
            self._by_name[schema.name], self._by_id[schema_id] = schema, schema.name
            listeners = list(self._listeners)
        for f in listeners:
            f("add", schema)
        return schema_id

    def del_schema(self, name: str) -> None:
        """Forget a schema; its records stay."""
        with self._lock:
            if name not in self._by_name:
                raise SchemaNotFound(name)
            schema = self._by_name.pop(name)
            del self._by_id[schema.id]
            listeners = list(self._listeners)
        for f in listeners:
            f("delete", schema)

    def get(self, name_or_id: str | int) -> Schema:
        with self._lock:
            name = self._by_id.get(name_or_id) if isinstance(name_or_id, int) else name_or_id
            if name not in self._by_name:
                raise SchemaNotFound(name_or_id)
            return self._by_name[name]

    def get_all(self) -> list[Schema]:
        with self._lock:
            return sorted(self._by_name.values(), key=lambda s: s.id)

    def subscribe(self, listener: Callable[[str, Schema], None]) -> None:
        """Call ``listener("add" | "delete", schema)`` on every change from now on."""
        with self._lock:
            self._listeners.append(listener)

    def empty_table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame([], self.get(name).struct())

    def list_tables(self, spark: SparkSession) -> DataFrame:
        rows = [(s.id, s.name, s.key, s.is_dynamic, s.is_scannable) for s in self.get_all()]
        return spark.createDataFrame(rows, "id int, name string, key string, is_dynamic boolean, is_scannable boolean")
