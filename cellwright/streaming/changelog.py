"""Record tables fed from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellwright.operators.kv import PUT, REMOVE, RecordTable, latest, retry


def _place(df: DataFrame, order: str):
    """The order column as a long: microseconds, days or the number itself."""
    kind = df.schema[order].dataType
    c = F.col(f"`{order}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise ValueError(f"{order} is no time and no whole number")


def fold_batch(table: RecordTable, batch: DataFrame, order: str, removed: str | None = None) -> int:
    """Commit the newest change of each key in one batch: an upsert, or a removal where ``removed`` (SQL) holds.

    The log keeps each event's order. An event older than the one that last
    changed its key, in whatever batch, is late and dropped; removals keep their
    order too, so a late event doesn't bring a record back. Changes that didn't
    come from a stream have no order and are older than any event.
    """
    # several changes of a key in one batch: only the newest counts, reduced before the shuffle
    newest = latest(batch.withColumn("_order", _place(batch, order)), table.key, ["_order"])
    gone = F.coalesce(F.expr(removed), F.lit(False)) if removed else F.lit(False)
    names = [f.name for f in table.schema.fields]
    rows = newest.withColumn("_op", F.when(gone, REMOVE).otherwise(PUT)).select(*[f"`{n}`" for n in names], "_op", "_order")

    def once() -> int:
        base = table.version()
        log = table.changes(base).join(rows.select(table.key), table.key, "left_semi").select(f"`{table.key}`", "_commit", "_seq", "_order")
        known = log.groupBy(F.col(table.key).alias("_k")).agg(F.max_by("_order", F.struct("_commit", "_seq")).alias("_known"))
        timely = rows.join(known, F.col(table.key) == F.col("_k"), "left").where("_known is null or _order >= _known")
        return table.write_changes(timely.drop("_k", "_known"), base)

    return retry(once)


def upsert_stream(table: RecordTable, stream: DataFrame, order: str, checkpoint: str, removed: str | None = None, **trigger) -> StreamingQuery:
    """Feed ``table`` from a stream of changes. ``order`` is a time or whole-number column that tells newer changes from older ones.

    A batch replayed after a failure repeats the same changes, which leaves the
    current view as it is.
    """
    def each(batch: DataFrame, _: int) -> None:
        if batch.head(1):
            fold_batch(table, batch, order, removed)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
