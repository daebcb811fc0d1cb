"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.sources.scratch import materialise, scope


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) of every vertex that has an edge, from edges (a, b) of longs, stored.

    Each round sends every vertex to the neighbour (or itself) that comes first
    in a fixed pseudo-random order and merges vertices with one target, which
    shrinks long chains geometrically. Minima are aggregated before any shuffle
    and stored before they are joined, so a vertex with very many edges is split.
    """
    spark = edges.sparkSession
    kept: list[DataFrame] = []

    def order(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    with scope(spark, kept):
        left = materialise(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
        steps: list[DataFrame] = []
        while left.head(1):
            both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = both.groupBy("a").agg(F.min(order("b")).alias("m"))
            to = materialise(near.select(F.col("a").alias("v"), F.least(order("a"), F.col("m"))["v"].alias("root")), f"{name}-step")
            steps.append(to)
            moved = left.join(to, F.col("a") == F.col("v")).select(F.col("root").alias("a"), "b")
            moved = moved.join(to, F.col("b") == F.col("v")).select("a", F.col("root").alias("b")).where("a <> b")
            left = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
        if not steps:
            return spark.createDataFrame([], "v bigint, root bigint")
        # follow the steps; a vertex that is no key of the next step keeps its place
        at = steps[-1]
        for to in reversed(steps[:-1]):
            nxt = at.select(F.col("v").alias("w"), F.col("root").alias("r"))
            at = materialise(to.join(nxt, F.col("root") == F.col("w"), "left").select("v", F.coalesce("r", "root").alias("root")), f"{name}-roots")
        kept.append(at)
        return at
