"""What the corpus operators share: word rules, word hashes, and guards for broadcast joins."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import cellwright

# Python functions travel to the executors by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[cellwright.__name__])

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes up to which a joined side may be broadcast; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table has at most ``rows`` rows and about ``size`` bytes. Reads ``rows`` + 1 rows at most."""
    some = df.limit(rows + 1)
    open_ended = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType)]
    width = F.lit(16 * len(df.columns))
    if open_ended:
        width = width + F.coalesce(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in open_ended]))), F.lit(0))
    n, total = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).head()
    return n <= rows and total <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it is a stored table of bounded rows and bytes, else unchanged."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out again if it has fewer partitions than there are cores, as a table in one row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def arrow_batches(spark: SparkSession, rows: int = 2_000, megabytes: int = 32) -> None:
    """Bound the batches that Python functions get, unless the session sets its own bounds."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words seen before; memory is bounded by ``most`` entries."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
