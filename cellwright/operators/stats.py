"""Table statistics, equi-depth histograms and scan costs."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.scan import Bound, ValueRange
from cellwright.sources.scratch import materialise
from cellwright.types import Schema

BUCKETS = 100


@dataclass(frozen=True)
class SchemaStatistics:
    count: int
    bytes: int
    partitions: int
    histograms: dict[str, list]


def column_ranges(df: DataFrame, *columns: str) -> DataFrame:
    """Rows, and the least and greatest value of each column, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("cnt"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])


def ranked(df: DataFrame, column: str) -> DataFrame:
    """(rn, k): every non-null value with its exact rank from 0, stored.

    The values are range partitioned and sorted; a rank is the value's place in
    its partition plus the sizes of the partitions before, so no single task sees
    all rows. Ranks of equal values follow no particular order.
    """
    runs = df.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).repartitionByRange("k").sortWithinPartitions("k")
    placed = materialise(runs.select("k", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "ranked")
    sizes = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        starts[r["p"]] = total
        total += r["n"]
    offsets = placed.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "p int, start long")
    return placed.join(F.broadcast(offsets), "p").select((F.col("i") + F.col("start")).alias("rn"), "k")


def equi_depth_keys(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(rn, k): the first value of each of ``buckets`` runs of equal length, and the last value; all values if there are at most ``buckets``."""
    ranks = ranked(df, column)
    n = ranks.agg(F.max("rn")).head()[0]
    n = 0 if n is None else n + 1
    depth = max(1, n // buckets)
    first = (F.col("rn") % depth == 0) & (F.col("rn") < buckets * depth)
    return ranks.where((first | (F.col("rn") == n - 1)) if n > buckets else F.lit(True))


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> list:
    """The keys of ``equi_depth_keys``, in order; at most ``buckets`` + 1."""
    return [r["k"] for r in equi_depth_keys(df, column, buckets).orderBy("rn").collect()]


def partition_histograms(df: DataFrame, column: str, part: str, buckets: int = BUCKETS) -> DataFrame:
    """(part, depth, keys): an equi-depth histogram of each part's values, from their ranks inside the part.

    The depth is the rows between two keys; a part with at most ``buckets`` values keeps all of them.
    """
    own = Window.partitionBy(part)
    placed = df.where(F.col(column).isNotNull()).select(part, F.col(column).alias("k"), (F.row_number().over(own.orderBy(column)) - 1).alias("rn"), F.count(F.lit(1)).over(own).alias("n"))
    depth = F.greatest(F.floor(F.col("n") / buckets), F.lit(1)).cast("long")
    place = F.col("rn") / F.col("depth")
    edge = (F.col("rn") % F.col("depth") == 0) & (place < F.when(F.col("n") > buckets, buckets).otherwise(F.col("n")))
    picked = placed.withColumn("depth", depth).withColumn("edge", edge).withColumn("top", (F.col("rn") == F.col("n") - 1) & ~edge)
    picked = picked.withColumn("seen", F.max(F.when(F.col("edge"), F.col("k"))).over(own))
    picked = picked.where("edge or (top and k <> seen)")  # a last value that is a key already isn't repeated
    return picked.groupBy(part).agg(F.first("depth").alias("depth"), F.transform(F.sort_array(F.collect_list(F.struct("rn", "k"))), lambda x: x["k"]).alias("keys"))


def merge_histograms(parts: Sequence[tuple[Sequence, int]], buckets: int = BUCKETS) -> list:
    """One equi-depth histogram of ``buckets`` + 1 keys from (keys, depth) of several partitions.

    Each key weighs its depth; key number i is the one at which the running
    weight reaches i shares of the total. The least and greatest keys stay.
    """
    weighted = sorted((k, d) for keys, d in parts for k in keys)
    if not weighted:
        return []
    total = sum(d for _, d in weighted)
    out, seen, at = [], 0, 0
    for i in range(buckets):
        while at < len(weighted) - 1 and (seen + weighted[at][1]) * buckets <= i * total:
            seen += weighted[at][1]
            at += 1
        out.append(weighted[at][0])
    return [*out, weighted[-1][0]]


def schema_statistics(df: DataFrame, columns: Sequence[str], schema: Schema | None = None, buckets: int = BUCKETS) -> SchemaStatistics:
    """Rows, estimated bytes, partitions and the histogram of each column."""
    n = df.count()
    width = schema.width() if schema else 32 * len(df.columns)
    return SchemaStatistics(n, n * width, df.rdd.getNumPartitions(), {c: histogram(df, c, buckets) for c in columns})


@dataclass(frozen=True)
class Cost:
    rows: int
    row_bytes: int

    @property
    def total(self) -> int:
        return self.rows * self.row_bytes


def row_bytes(stats: SchemaStatistics, schema: Schema, projection: Sequence[str] = ()) -> int:
    """Bytes of a row: the projected fields' widths, or the average row."""
    return schema.width(list(projection)) if projection else stats.bytes // max(1, stats.count)


def scan_cost(stats: SchemaStatistics, schema: Schema, projection: Sequence[str] = ()) -> Cost:
    return Cost(stats.count, row_bytes(stats, schema, projection))


def share_below(keys: Sequence, value: Any) -> float:
    """The share of rows below ``value``, by a histogram's keys: whole buckets, and numbers in proportion inside one."""
    if len(keys) < 2:
        return 0.0 if not keys or value <= keys[0] else 1.0
    k = bisect.bisect_left(keys, value)
    if k == 0:
        return 0.0
    if k == len(keys):
        return 1.0
    low, high = keys[k - 1], keys[k]
    numbers = all(isinstance(x, int | float | Decimal) for x in (low, high, value))
    inside = float(value - low) / float(high - low) if numbers and high > low else 0.0
    return (k - 1 + inside) / (len(keys) - 1)


def range_cost(stats: SchemaStatistics, schema: Schema, field: str, value_range: ValueRange, projection: Sequence[str] = ()) -> Cost | None:
    """Rows by the share of the field's histogram between the range's ends; None without a histogram."""
    keys = stats.histograms.get(field)
    if not keys:
        return None
    start, end = value_range.start, value_range.end
    low = 0.0 if start.bound is Bound.OPEN else share_below(keys, start.value)
    high = 1.0 if end.bound is Bound.OPEN else share_below(keys, end.value)
    return Cost(int(max(0.0, high - low) * stats.count), row_bytes(stats, schema, projection))


def total_cost(costs: Sequence[Cost]) -> int:
    return sum(c.total for c in costs)


def choose(stats: SchemaStatistics, schema: Schema, field: str, value_range: ValueRange, projection: Sequence[str] = ()) -> str:
    """"range" if the range scan is estimated to be cheaper than the full scan, else "scan"."""
    ranged = range_cost(stats, schema, field, value_range, projection)
    return "range" if ranged is not None and ranged.total < scan_cost(stats, schema, projection).total else "scan"
