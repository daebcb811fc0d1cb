"""Benchmark decontamination by template windows.

Texts and benchmark items become templates: numbers, names (capitalised words
inside a sentence) and units of measure turn into typed placeholders, other
words are lower-cased and lose their punctuation. Windows of ``WINDOW`` template
words of the items are hash-joined with the windows of all documents.

An item that contaminates a document matches ``MIN_COVERAGE`` of its windows, so
at least one of any others that leave fewer. The first join therefore takes each
item's windows but for those that most items share, as many as may be left out;
it yields candidate pairs of document and item. Only these are aligned with all
their windows: hits of a pair are grouped by shift, and a shift's slots are
consistent if every value of the item stands for one value of the document, which
also catches re-parameterised questions. Windows with placeholders count in
consistent shifts, windows without any in all. A document is contaminated by an
item if the windows that count cover ``MIN_COVERAGE`` of the item's.

Windows with mostly placeholders don't count; an item that has no others is
matched by its plain words instead. Only DataFrame functions are used. Hashes of
item windows are broadcast if they are few and joined by shuffle otherwise.
Defined results: null or short texts have no windows; items of 3 to WINDOW - 1
words are matched as one window, shorter ones never; rows are told apart by id
and text, so repeated rows share their verdict; a null id is a value like any
other; empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import SPACE, small_side, spread
from cellwright.sources.scratch import materialise, scope

WINDOW = 6
LEAST_WORDS = 3
#: Share of a window's words that aren't placeholders.
LITERALS = 0.6
MIN_COVERAGE = 0.3
#: Hashes of item windows that may be broadcast: 16 MB.
SHARED_HASHES = 1_000_000

# Units of measure.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g mg kg lb lbs ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups"
    " second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees meter meters metre metres").split()

NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
_NAME = r"\p{Lu}(?<=[^.!?:\s][ \t]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
# at most 20 groups at a time: Java's matcher recurses once a group
_NUMBER = r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,:/][0-9]+){0,20}(?![\p{L}\p{N}])"
_OTHER = r"[^\p{L}\p{N}\x01\x02\x20\x09-\x0D]+"


def _tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, SPACE), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation, one for each template word."""
    return _tokens(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _OTHER, ""))


def template_words(text: Column) -> Column:
    """Words with names, numbers and units replaced by placeholders."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, NAME)
    t = F.regexp_replace(t, _NUMBER, NUMBER)
    return F.transform(_tokens(F.regexp_replace(F.lower(t), _OTHER, "")), lambda w: F.when(w.isin(*UNITS), F.lit(UNIT)).otherwise(w))


def _windows(hashes: Column, size: int) -> Column:
    """Hash of each window of ``size`` words, in order, from the array of the words' hashes."""
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(item_id, ipos, size, plain, h, tmpl, raw, n_windows, first) of every item, stored.

    ``plain``: the item is matched by its plain words; ``first``: the window takes part in the first join.
    """
    w = benchmark.select(benchmark["item_id"], template_words(benchmark["text"]).alias("t"), plain_words(benchmark["text"]).alias("p")).distinct()
    w = w.where(F.size("t") >= LEAST_WORDS).withColumn("size", F.least(F.size("t"), F.lit(window)))
    w = w.select("item_id", "size", "t", "p", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("ipos"))
    w = w.select("item_id", "ipos", "size", F.slice("t", F.col("ipos") + 1, F.col("size")).alias("tmpl"), F.slice("p", F.col("ipos") + 1, F.col("size")).alias("raw"))
    literal = F.size(F.filter("tmpl", lambda x: ~x.isin(NAME, NUMBER, UNIT))) >= F.ceil(F.col("size") * LITERALS)
    each = Window.partitionBy("item_id")  # an item is one text
    w = w.withColumn("literal", literal).withColumn("plain", ~F.max("literal").over(each)).where("literal or plain")
    w = w.withColumn("tmpl", F.when(F.col("plain"), F.col("raw")).otherwise(F.col("tmpl"))).drop("literal")
    # the hash that _windows gives
    h = _hashes(F.col("tmpl"))
    of_size = F.lit(None).cast("long")
    for k in range(LEAST_WORDS, max(window, LEAST_WORDS) + 1):
        of_size = F.when(F.col("size") == k, F.get(_windows(h, k), F.lit(0))).otherwise(of_size)
    stored = materialise(w.withColumn("h", of_size), "benchmark-windows")
    shared = stored.groupBy(F.col("h").alias("_h")).agg(F.countDistinct("item_id").alias("items"))
    stored = stored.join(shared, F.col("h") == F.col("_h")).drop("_h")
    rank = F.row_number().over(each.orderBy("items", "h", "ipos"))
    stored = stored.withColumn("n_windows", F.count(F.lit(1)).over(each)).withColumn("_r", rank)
    first = F.col("_r") <= F.col("n_windows") - F.ceil(F.col("n_windows") * min_coverage - 1e-9) + 1
    return materialise(stored.withColumn("first", first).drop("_r", "items"), "benchmark-items")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, coverage, verbatim) of each contaminated document and item, stored.

    ``verbatim``: all slots of the windows that count have the item's own values.
    """
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        kept.append(_find(docs, benchmark, window, min_coverage))
    return kept[0]


def _find(docs: DataFrame, benchmark: DataFrame, window: int, min_coverage: float) -> DataFrame:
    items = item_windows(benchmark, window, min_coverage)
    forms = sorted((r["size"], r["plain"]) for r in items.select("size", "plain").distinct().collect())  # at most 2 WINDOW values
    keyed = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"), docs["text"])

    def hashed(texts: DataFrame) -> DataFrame:
        # as columns of their own: inside a lambda an expression would be computed again for each window
        return texts.select("*", template_words(F.col("text")).alias("t"), plain_words(F.col("text")).alias("p")).select("*", _hashes(F.col("t")).alias("ht"), _hashes(F.col("p")).alias("hp"))

    def placed(made) -> Column:
        def of_form(size: int, plain: bool) -> Column:
            return F.transform(_windows(F.col("hp" if plain else "ht"), size), lambda h, i: made(h, i, size, plain))

        each = [of_form(*f) for f in forms or [(window, False)]]
        return each[0] if len(each) == 1 else F.concat(*each)

    # candidate pairs: only hashes are compared, and texts aren't shuffled
    seen = hashed(spread(keyed)).select("doc_id", "text_hash", F.explode(F.array_distinct(placed(lambda h, i, s, p: h))).alias("h"))
    hashes = small_side(materialise(items.where("first").select("h").distinct(), "benchmark-hashes"), SHARED_HASHES)
    seen = seen.join(hashes, "h", "left_semi")
    pairs = seen.join(items.where("first").select("h", "item_id"), "h").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.col("item_id").alias("_it")).distinct()
    pairs = materialise(pairs, "benchmark-pairs")
    # what the items of these documents would have there
    want = pairs.join(items, F.col("_it").eqNullSafe(F.col("item_id"))).select("_id", "_th", "item_id", "ipos", F.col("size").alias("_size"), F.col("plain").alias("_plain"), F.col("h").alias("_h"), "tmpl", "raw", "n_windows")
    some = small_side(materialise(pairs.select("_id", "_th").distinct(), "benchmark-suspects"))
    hit = keyed.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left_semi")
    hit = hashed(hit.distinct())
    full = placed(lambda h, i, s, p: F.struct(
        h.alias("h"), i.alias("dpos"), F.lit(s).alias("size"), F.lit(p).alias("plain"), F.slice("p" if p else "t", i + 1, F.lit(s)).alias("dt"), F.slice("p", i + 1, F.lit(s)).alias("dw")))
    every = small_side(materialise(items.select("h").distinct(), "benchmark-hashes"), SHARED_HASHES)  # most windows of these documents are none of any item
    own = hit.select("doc_id", "text_hash", F.explode(full).alias("w")).select("doc_id", "text_hash", "w.*").join(every, "h", "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")) & (F.col("h") == F.col("_h")) & (F.col("size") == F.col("_size")) & (F.col("plain") == F.col("_plain"))
    aligned = own.join(want, same).where(F.col("dt") == F.col("tmpl"))
    # slots by shift: each window's place with its slots; at most the item's windows
    slots = F.filter(F.arrays_zip(F.col("tmpl").alias("k"), F.col("raw").alias("i"), F.col("dw").alias("d")), lambda z: ~F.col("plain") & z["k"].isin(NAME, NUMBER, UNIT))
    shifted = aligned.groupBy("doc_id", "text_hash", "item_id", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(
        F.max("n_windows").alias("n"), F.collect_set(F.struct("ipos", slots.alias("slots"))).alias("hits"))
    filled = F.array_distinct(F.flatten(F.transform("hits", lambda x: x["slots"])))
    consistent = F.size(filled) == F.size(F.array_distinct(F.transform(filled, lambda z: F.struct(z["k"], z["i"]))))
    shifted = shifted.withColumn("consistent", consistent).withColumn("hits", F.filter("hits", lambda x: F.col("consistent") | (F.size(x["slots"]) == 0)))
    verbatim = F.forall("hits", lambda x: F.forall(x["slots"], lambda z: z["i"] == z["d"]))
    found = shifted.where(F.size("hits") > 0).groupBy("doc_id", "text_hash", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("hits", lambda x: x["ipos"]))))).cast("long").alias("matched"), F.max("n").alias("n"), F.min(verbatim).alias("verbatim"))
    found = found.withColumn("coverage", F.col("matched") / F.col("n")).where(F.col("coverage") >= min_coverage).drop("n")
    return materialise(found.select("doc_id", "text_hash", "item_id", "matched", "coverage", "verbatim"), "benchmark-found")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates, with their own columns."""
    found = find(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct()
    found = small_side(materialise(found, "benchmark-drop"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_th"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs, benchmark).selectExpr("doc_id", "item_id", "matched", "round(coverage, 6) as coverage", "verbatim")
