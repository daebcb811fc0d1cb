"""Records by key over an append-only change log.

A table is a folder: ``data/`` has one Parquet folder a commit, ``commits/`` one
small file a commit. That file is written aside and takes its final name in one
atomic step, which fails if another writer has made the commit: a hard link on a
local file system, a rename that never replaces on HDFS. (Object stores have no
such step; a table needs a file system that has.) Nothing is ever changed in
place, so a reader pins a version, and a writer that dies at any point leaves
nothing that is seen or that holds up others. The rows of a change are computed
once: they are checked as written, or kept under ``staged/`` until they are
joined. The current view is the newest change of every key, by
commit and then by place in the commit; removed keys are left out. It is an
aggregate with partial results before the shuffle, so a key with very many
changes is no hot spot. ``compact`` writes the view as a new base, which later
reads start from.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.types import relaxed

META = ("_op", "_commit", "_seq", "_version", "_ts", "_order")
PUT, REMOVE = "put", "remove"
#: Sizes from here on are the planner's mark of a table whose size it doesn't know.
UNKNOWN_BYTES = 1 << 56


class CellError(Exception):
    """An operation that its keys don't allow; nothing was committed."""

    def __init__(self, what: str, keys: list):
        super().__init__(f"{what}: {keys[:5]}" + (" and more" if len(keys) > 5 else ""))
        self.keys = keys


class CellAlreadyExisted(CellError):
    pass


class CellDoesNotExist(CellError):
    pass


class CommitConflict(Exception):
    """Another writer changed the same keys, or made the same commit, first."""


@dataclass(frozen=True)
class Commit:
    version: int
    kind: str  # delta or base
    path: str


def latest(changes: DataFrame, key: str, order: list[str], removed: Column | None = None) -> DataFrame:
    """The newest row of each key by ``order``; keys whose newest row is ``removed`` are left out."""
    others = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(*[F.col(c) for c in order])).alias("_r")
    out = changes.groupBy(key).agg(newest).select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*changes.columns)
    return out if removed is None else out.where(~F.coalesce(removed, F.lit(False)))


def touched(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The rows of a large ``table`` whose key is among the ``incoming`` ones.

    A small side is broadcast, and the join moves below the aggregate of a
    current view, so the table is filtered where it is read.
    """
    return table.join(incoming.select(key), key, "left_semi")


def _met(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``table`` for a join from ``incoming``: its ``touched`` rows, or all if the planner knows the keys as too large to broadcast.

    With large keys ``touched`` filters nothing early: it would only compute and
    sort the incoming rows once more, in the same tasks as the join. Both sides
    are then shuffled: file sizes say too little of the rows to broadcast a table.
    """
    size = incoming.select(key)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table.hint("merge") if most < size < UNKNOWN_BYTES else touched(table, incoming, key)


def insert_if_absent(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key the table doesn't have."""
    return incoming.join(_met(table, incoming, key).select(key), key, "left_anti")


def update_existing(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key the table has."""
    return incoming.join(_met(table, incoming, key).select(key), key, "left_semi")


class RecordTable:
    """A keyed table at ``path``; made there if there is none."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(f"{self.path}/commits"))

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # commits

    def commits(self) -> list[Commit]:
        out = []
        for status in self._fs.listStatus(self._hadoop(f"{self.path}/commits")):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                stream = self._fs.open(status.getPath())
                try:
                    raw = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
                if raw:
                    out.append(Commit(**json.loads(raw)))
        return sorted(out, key=lambda c: c.version)

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((c.version for c in self.commits()), default=0)

    def _publish(self, version: int, kind: str, path: str) -> None:
        """Make the commit's file: its content is written aside and renamed to a name that must be free."""
        aside = self._hadoop(f"{self.path}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "kind": kind, "path": path}).encode()))
        stream.close()
        final = self._hadoop(f"{self.path}/commits/{version:020d}.json")
        try:
            made = self._take_name(aside, final)
        finally:
            self._fs.delete(aside, False)
        if not made:
            raise CommitConflict(f"commit {version} was made by another writer")

    def _take_name(self, aside, final) -> bool:
        """Give the file ``aside`` its final name; False if the name is taken."""
        if self._fs.getUri().getScheme() != "file":
            return not self._fs.exists(final) and self._fs.rename(aside, final)
        local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(local(final), local(aside))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    # reading

    def _empty(self) -> DataFrame:
        meta = T.StructType([T.StructField("_op", T.StringType()), T.StructField("_commit", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_version", T.LongType()), T.StructField("_ts", T.TimestampType()), T.StructField("_order", T.LongType())])
        return self.spark.createDataFrame([], relaxed(T.StructType([*self.schema.fields, *meta.fields])))

    def changes(self, version: int | None = None, after: int = 0) -> DataFrame:
        """All changes up to a version, from the last base before it, or only those after a commit."""
        known = [c for c in self.commits() if version is None or c.version <= version]
        if after:
            known = [c for c in known if c.version > after and c.kind == "delta"]
        else:
            base = max((c.version for c in known if c.kind == "base"), default=0)
            known = [c for c in known if c.version >= base]
        if not known:
            return self._empty()
        return self.spark.read.schema(relaxed(self._empty().schema)).parquet(*[f"{self.path}/data/{c.path}" for c in known])

    def current(self, version: int | None = None, headers: bool = False) -> DataFrame:
        """The newest version of every key that isn't removed."""
        rows = latest(self.changes(version), self.key, ["_commit", "_seq"], F.col("_op") == REMOVE)
        return rows.drop("_op", "_seq") if headers else rows.drop(*META)

    def head(self, key=None) -> DataFrame:
        """Key, version, commit and time of one record, or of all."""
        changes = self.changes().select(f"`{self.key}`", *META)
        if key is not None:
            changes = changes.where(F.col(self.key) == F.lit(key))
        return latest(changes, self.key, ["_commit", "_seq"], F.col("_op") == REMOVE).select(self.key, "_version", "_commit", "_ts")

    def get(self, key, version: int | None = None) -> dict | None:
        rows = latest(self.changes(version).where(F.col(self.key) == F.lit(key)), self.key, ["_commit", "_seq"], F.col("_op") == REMOVE).drop(*META).head(1)
        return rows[0].asDict(recursive=True) if rows else None

    def count(self) -> int:
        return self.current().count()

    # writing

    def _conform(self, df: DataFrame) -> DataFrame:
        missing = [f.name for f in self.schema.fields if f.name not in df.columns and not f.nullable]
        if missing:
            raise ValueError(f"required fields are missing: {missing}")
        return df.select(*[(df[f"`{f.name}`"] if f.name in df.columns else F.lit(None)).cast(relaxed(f.dataType)).alias(f.name) for f in self.schema.fields])

    @contextmanager
    def _staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` as stored in the table's folder while they are used: they are computed once, however often they are joined."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(relaxed(rows.schema)).parquet(path)
        finally:
            self._fs.delete(self._hadoop(path), True)

    def write_changes(self, changes: DataFrame, base: int | None = None, kind: str = "delta", check: Callable[[DataFrame], None] | None = None) -> int:
        """Commit rows that have ``_op`` (and maybe ``_seq``, ``_version`` and ``_order``, the place of a stream's event) on top of version ``base``; the new version.

        ``check`` gets the rows as written, before their commit; if it raises, they are deleted and nothing is committed.
        """
        base = self.version() if base is None else base
        version, path = base + 1, uuid.uuid4().hex
        extra = {"_commit": F.lit(version).cast("long"), "_ts": F.current_timestamp()}
        if "_seq" not in changes.columns:
            extra["_seq"] = F.lit(0).cast("long")
        if "_version" not in changes.columns:
            extra["_version"] = F.lit(1).cast("long")
        if "_order" not in changes.columns:
            extra["_order"] = F.lit(None).cast("long")
        rows = changes.withColumns(extra).select(*[F.col(f"`{f.name}`").cast(relaxed(f.dataType)).alias(f.name) for f in self.schema.fields], *META)
        rows.write.parquet(f"{self.path}/data/{path}")
        if check is not None:
            try:
                check(self.spark.read.schema(relaxed(rows.schema)).parquet(f"{self.path}/data/{path}"))
            except BaseException:
                self._fs.delete(self._hadoop(f"{self.path}/data/{path}"), True)
                raise
        self._publish(version, kind, path)
        return version

    def _some(self, df: DataFrame) -> list:
        return [r[0] for r in df.select(self.key).limit(6).collect()]

    def _put(self, rows: DataFrame, base: int, check: Callable[[DataFrame], None] | None = None) -> int:
        """Commit records with the versions that follow their old ones; 1 is a new record's."""
        with self._staged(rows) as rows:
            old = _met(self.current(base, headers=True), rows, self.key)
            versions = old.select(F.col(self.key).alias("_k"), F.greatest("_version", F.lit(1)).alias("_old"))
            put = rows.join(versions, F.col(self.key) == F.col("_k"), "left").withColumn("_version", F.coalesce(F.col("_old"), F.lit(0)) + 1)
            return self.write_changes(put.drop("_k", "_old").withColumn("_op", F.lit(PUT)), base, check=check)

    def insert(self, df: DataFrame) -> int:
        """Write new records; none may exist, and no key may come twice."""
        base = self.version()

        def check(rows: DataFrame) -> None:
            held = self._some(update_existing(self.current(base), rows, self.key)) if base else []
            held = held or self._some(rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            if held:
                raise CellAlreadyExisted("records exist", held)

        return self.write_changes(self._conform(df).withColumn("_op", F.lit(PUT)), base, check=check)

    def update(self, df: DataFrame) -> int:
        """Replace records; all must exist."""

        def check(rows: DataFrame) -> None:
            absent = self._some(rows.where("_version = 1"))
            if absent:
                raise CellDoesNotExist("no such records", absent)

        return self._put(self._conform(df), self.version(), check)

    def upsert(self, df: DataFrame) -> int:
        return self._put(self._conform(df), self.version())

    def remove(self, keys: DataFrame) -> int:
        """Remove the records of a table of keys; all must exist."""
        base = self.version()
        with self._staged(keys.select(self.key).distinct()) as keys:
            old = self.current(base)
            absent = self._some(insert_if_absent(old, keys, self.key))
            if absent:
                raise CellDoesNotExist("no such records", absent)
            return self._drop(touched(old, keys, self.key), base)

    def _drop(self, rows: DataFrame, base: int) -> int:
        gone = [F.col(self.key) if f.name == self.key else F.lit(None).cast(relaxed(f.dataType)).alias(f.name) for f in self.schema.fields]
        return self.write_changes(rows.select(*gone).withColumn("_op", F.lit(REMOVE)), base)

    def update_by(self, predicate: Column | str, changes: Mapping[str, Column | str]) -> int:
        """Compute new field values for the records where ``predicate`` holds."""
        base = self.version()
        old = self.current(base, headers=True)
        hit = old.where(predicate)
        new = hit.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in changes.items()}).withColumn("_version", F.col("_version") + 1)
        return self.write_changes(new.drop("_commit", "_ts").withColumn("_op", F.lit(PUT)), base)

    def remove_by(self, predicate: Column | str) -> int:
        base = self.version()
        return self._drop(self.current(base).where(predicate), base)

    def compact(self, files: int | None = None) -> int:
        """Write the current view as a new base; earlier commits stay readable by version."""
        base = self.version()
        rows = self.current(base, headers=True).drop("_commit", "_ts").withColumn("_op", F.lit(PUT))
        return self.write_changes(rows.coalesce(files) if files else rows, base, "base")

    def vacuum(self) -> int:
        """Delete the data of commits before the last base; the number of commits dropped."""
        known = self.commits()
        base = max((c.version for c in known if c.kind == "base"), default=0)
        old = [c for c in known if c.version < base]
        for c in old:
            self._fs.delete(self._hadoop(f"{self.path}/data/{c.path}"), True)
            self._fs.delete(self._hadoop(f"{self.path}/commits/{c.version:020d}.json"), False)
        return len(old)

    def archive(self, path: str) -> None:
        """Copy the current view to Parquet at ``path``."""
        self.current().write.parquet(path)

    def dump(self) -> DataFrame:
        """The current view, a JSON document a row."""
        return self.current().select(F.to_json(F.struct("*")).alias("json"))


def retry(run: Callable[[], int], attempts: int = 1000, wait: float = 0.01) -> int:
    """``run`` until it doesn't meet a conflict."""
    for k in range(attempts):
        try:
            return run()
        except CommitConflict:
            if k + 1 == attempts:
                raise
            time.sleep(min(1.0, wait * (k + 1)))
    raise ValueError("attempts must be positive")
