"""Unbounded sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repeat_stream(spark: SparkSession, value, type_name: str = "bigint", rows_per_second: int = 1_000) -> DataFrame:
    """One value without end."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.lit(value).cast(type_name).alias("v"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """The files of a folder, each once, as they come."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
