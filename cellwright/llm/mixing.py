"""Mixing sources to target weights with a time-varying curriculum.

Every source gets a target: a share, by weight, of ``budget`` times all words,
never above ``max_epochs`` times its own words; what a full source can't take is
shared again by weight (water filling, solved in closed form). Each source also
has a schedule, a weight that moves in a straight line from ``start`` to ``end``
over training. Its integral is the source's cumulative demand; inverting that
gives the training position at which a document's words fall due. Documents are
sorted by position over range partitions.

Documents of a source stand in a fixed pseudo-random order. Their running sums
come from three levels, so that no task holds a whole source: sums of groups of
hash buckets, running sums of the buckets in a group, then a running sum inside a
bucket (buckets are shared by all sources). A copy of a
document is taken if at least half of it lies before the target. The sources
themselves are ranked in one task, a row a source.

Only DataFrame functions are used. Defined results: null or blank text has size
0 and takes 0 words; a null source is the last source; repeated rows count each;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import WORD, small_side
from cellwright.sources.scratch import materialise

WEIGHTS = (3, 1, 2)
#: (start, end) of each source's weight over training, repeating in source order.
SCHEDULES = ((1.0, 1.0), (1.0, 3.0), (3.0, 1.0))
BUDGET = 1.5
MAX_EPOCHS = 2
#: Rows that a bucket holds on average at most.
BUCKET_ROWS = 4_000
LEAST_BUCKETS = 1_024


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
            schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """(source, source_size, target, start, end) from (source, source_size), one row a source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_r", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumns({
        "_w": _cycle(weights, F.col("_r")), "_cap": max_epochs * F.col("source_size").cast("double"),
        "start": _cycle([s for s, _ in schedules], F.col("_r")), "end": _cycle([e for _, e in schedules], F.col("_r")),
    })
    # fill level: with sources in the order in which they fill up, the last level at which the demand still reaches the total
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    full = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    filled = ranked.withColumns({"_total": total, "_full": full, "_open": open_weight})
    reach = F.col("_full") + F.col("_cap") / F.col("_w") * F.col("_open") >= F.col("_total")
    level = F.max(F.when(reach, (F.col("_total") - F.col("_full")) / F.col("_open"))).over(everything)
    return filled.withColumn("_level", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("_w") * F.col("_level"), F.col("_cap")), F.col("_cap")).alias("target"), "start", "end")


def position(share: Column, start: Column, end: Column) -> Column:
    """The training position (0 to 1) at which ``share`` of a source's demand has fallen due; linear beyond 1."""
    inside = F.least(share, F.lit(1.0))
    curved = (F.sqrt(start * start + (end * end - start * start) * inside) - start) / (end - start)
    return F.when(start == end, inside).otherwise(curved) + (share - inside)


def assign(docs: DataFrame, source: str = "source", text: str = "text", size: Column | None = None, order: Column | None = None, **options) -> DataFrame:
    """``docs`` packed as ``_d``, with size, source_size, target, copies, taken, position and position_again (of a second copy).

    ``size`` and ``order`` (a long hash) default to the words and the hash of the text.
    """
    names = docs.columns
    keyed = docs.select(
        F.struct(*[docs[c] for c in names]).alias("_d"), docs[source].cast("string").alias("source"),
        (word_count(docs[text]) if size is None else size).alias("size"), (F.xxhash64(docs["doc_id"], docs[text]) if order is None else order).alias("_h"),
    )
    max_epochs = options.get("max_epochs", MAX_EPOCHS)
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    keyed = keyed.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    sums = materialise(keyed.groupBy("source", "_b").agg(F.sum("size").alias("_s")), "mix-buckets")
    goal = materialise(targets(sums.groupBy("source").agg(F.sum("_s").alias("source_size")), **options), "mix-targets")
    # about as many buckets in a group as groups
    sums = sums.withColumn("_g", F.floor(F.col("_b") / math.ceil(math.sqrt(buckets))).cast("int"))
    before = lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy(F.col("source").alias("_gs"), F.col("_g").alias("_gg")).agg(F.sum("_s").alias("_s"))
    groups = groups.select("_gs", "_gg", before(Window.partitionBy("_gs").orderBy("_gg")).alias("_group"))
    plan = sums.select("source", "_b", "_g", before(Window.partitionBy("source", "_g").orderBy("_b")).alias("_inside"))
    plan = plan.join(groups, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("_g") == F.col("_gg")))
    plan = plan.select(F.col("source").alias("_src"), F.col("_b").alias("_pb"), (F.col("_group") + F.col("_inside")).alias("_before"))
    goal = goal.withColumnRenamed("source", "_gsrc")
    plan = materialise(plan.join(small_side(goal), F.col("_src").eqNullSafe(F.col("_gsrc"))).drop("_gsrc"), "mix-plan")
    inside = Window.partitionBy("_b", "source").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.repartition(F.col("_b")).withColumn("_in", F.sum("size").over(inside))
    rows = rows.join(small_side(plan), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_pb")))
    middle = F.col("_before") + F.col("_in") - F.col("size") / 2
    copies = F.aggregate(F.sequence(F.lit(0), F.lit(max_epochs - 1)), F.lit(0), lambda a, k: a + F.when(middle + k * F.col("source_size") <= F.col("target"), 1).otherwise(0))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
    share = lambda k: F.coalesce(F.try_divide(middle + k * F.col("source_size"), F.col("target")), F.lit(1.0))
    return rows.select(
        "_d", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        position(share(0), F.col("start"), F.col("end")).alias("position"),
        F.when(F.col("copies") > 1, position(share(1), F.col("start"), F.col("end"))).alias("position_again"),
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training set in order: a row for each copy taken, with ``copy`` and ``position``, range-sorted by position."""
    rows = assign(docs, **options).where("copies > 0")
    each = F.array(F.struct(F.lit(1).alias("copy"), F.col("position").alias("position")), F.struct(F.lit(2).alias("copy"), F.col("position_again").alias("position")))
    due = rows.select("_d", F.explode(F.filter(each, lambda x: x["position"].isNotNull())).alias("_c"))
    names = [c for c in due.schema["_d"].dataType.names if c not in ("copy", "position")]
    return due.select(*[F.col("_d")[c].alias(c) for c in names], "_c.copy", "_c.position").orderBy("position", "doc_id", "copy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("h")), "mix-sizes")
    mixed = assign(sized, size=F.col("n"), order=F.col("h"), text="n")
    return mixed.orderBy("position", "_d.doc_id").select("_d.doc_id", "size", "source_size", "target", "taken", "copies", "position", "position_again")
