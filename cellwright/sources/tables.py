"""Tables from files, and engine sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table in any format Spark reads; text formats need a schema, so that no pass is spent on guessing one."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", sort: tuple[str, ...] = (), partition: tuple[str, ...] = (), **options) -> None:
    """Write a table; ``sort`` keys are range partitioned and sorted, so that file statistics can skip row groups for their ranges."""
    if sort:
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def session(cpus: int | str = "*", memory: str = "12g", partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with this engine's settings; on a cluster the caller makes the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cellwright").config("spark.driver.memory", memory)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(partitions or (cpus if isinstance(cpus, int) else 8)),
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
