"""Quality rules with risk-controlled thresholds.

Fixed base rules reject very short and very repetitive texts. Beyond them, each
stratum (language) gets its own cutoffs for a few statistics. The rules have
``LEVELS`` cutoffs each, from lax to strict; level j rejects a document that
fails any rule's j-th cutoff, so the levels are nested. Documents labelled good
are the holdout: a level is safe if they prove, by an exact binomial bound, that
it rejects at most ``max_false_rejection`` of the good documents of the stratum.

Levels are tested in order, from lax to strict, and testing stops at the first
that isn't proven; in such a fixed sequence no correction is needed for the
number of levels, and the rules share one risk as they are tested together. Over
strata the error level is divided (Bonferroni). Strata with too few labels for
any proof, which their number alone tells, aren't tested and don't count. So all
chosen cutoffs hold together with probability at least ``1 - delta``. With the
defaults a stratum needs 149 good documents if it is tested alone, 217 if it is
one of four.

Only DataFrame functions are used. Defined results: null text is empty (no
words, base_failed); unlabelled or null-quality rows don't vote; a null
language is a stratum of its own; an empty table gives an empty result;
repeated rows are judged each on its own; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import small_side, spread, words
from cellwright.sources.scratch import materialise, scope

WINDOW = 8
#: Rule -> (expression over the statistics, cutoffs from lax to strict): a document fails above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.2, 0.8, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "capitals": ("n_upper / greatest(word_chars, 1)", (0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "long_words": ("word_chars / greatest(n_words, 1)", (50.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
}
LEVELS = 8
MAX_FALSE_REJECTION = 0.02
DELTA = 0.05


def _repeat_words(w: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the array ``w`` of word hashes."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        # sorted by (hash, position): equal windows are neighbours; then count what their positions cover
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _with(pairs, lambda s: _with(
            F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(
                x["i"].alias("i"),
                (((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))).alias("again"),
            )), lambda x: x["again"]), lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x),
        ))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(
        _with(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def _with(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the rule statistics appended (n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = _with(F.struct(words(F.col(text)).alias("w"), lines.alias("l")), lambda s: F.struct(
        F.size(s["w"]).cast("long").alias("n_words"),
        F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
        F.size(s["l"]).cast("long").alias("n_lines"),
        (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
        _with(F.transform(s["w"], lambda x: F.xxhash64(x)), _repeat_words).cast("long").alias("n_repeat_words"),
    ))
    return (
        docs.withColumn("_s", stats)
        .withColumns({
            **{c: F.col(f"_s.{c}") for c in ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words")},
            "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
        })
        .drop("_s")
        .withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    )


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series after a shift by 8."""
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). Terms are summed downwards from k, each from the one above; 1.0 where k >= n p (never a proof).

    Below k < n p the m-th further term is less than exp(-m (m - 1) / 2k) of the
    first, so what follows m = 10 sqrt(k) + 2 is beyond a double's precision.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = (_log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    # term(j-1) = term(j) * j (1-p) / ((n-j+1) p)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(10 * F.sqrt(kd)).cast("long") + 2)),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (kd - i) * ((1 - p) / p) / (nd - kd + i + 1)).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(nd <= 0, F.lit(1.0)).when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def thresholds(feats: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id",
               max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """(stratum, n, level, one ``cut_<rule>`` per rule) of each stratum with a proven level, from stored statistics.

    The holdout is the documents labelled good that pass the base rules; n counts them.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    held = feats.where("not base_failed").join(good, F.col(doc_id) == F.col("_id"), "left_semi")
    fails = [" or ".join(f"{e} > {cuts[j]}" for e, cuts in RULES.values()) for j in range(LEVELS)]
    sums = [F.count_if(F.expr(f)).alias(f"k{j}") for j, f in enumerate(fails)]
    counts = materialise(held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *sums), "quality-counts")
    # as many strata as can be tested at once, from the largest; a row a stratum
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc())))
    able = F.max(F.when(F.pow(F.lit(1 - max_false_rejection), F.col("n")) <= F.lit(delta) / F.col("r"), F.col("r"))).over(Window.partitionBy())
    ranked = ranked.withColumn("error", F.coalesce(F.lit(delta) / able, F.lit(0.0)))
    proven = F.array(*[binomial_tail(F.col(f"k{j}"), F.col("n"), max_false_rejection) <= F.col("error") for j in range(LEVELS)])
    first = F.array_position(proven, False)  # the first that isn't proven; 0 if all are
    tested = ranked.select("stratum", "n", F.when(first == 0, F.lit(LEVELS)).otherwise(first - 1).cast("int").alias("level"))
    return tested.where("level > 0").select("stratum", "n", "level", *[F.element_at(F.array(*map(F.lit, cuts)), F.col("level")).alias(f"cut_{r}") for r, (_, cuts) in RULES.items()])


def verdict(feats: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``feats`` with ``kept``. ``cuts`` is a stored table of one row per stratum; it is broadcast if small."""
    # one number that is never null: a filter on it has no part, and implies no null check, that would move below the
    # join and compute the statistics again
    failures = F.col("base_failed").cast("int")
    for rule, (e, _) in RULES.items():
        failures = failures + F.coalesce((F.expr(e) > F.col(f"cut_{rule}")).cast("int"), F.lit(0))
    return (
        feats.join(small_side(cuts.drop("n", "level")), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
        .withColumn("kept", F.coalesce(failures, F.lit(1)) == 0)
        .drop("stratum", *[f"cut_{r}" for r in RULES])
    )


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every document. Statistics are computed once and stored."""
    cols = {f.name for f in docs.schema}
    src = docs.select("doc_id", "text", (F.col("lang") if "lang" in cols else F.lit(None).cast("string")).alias("lang"))
    return _judged(features(spread(src)).drop("text"), labels, **options)


def _judged(feats: DataFrame, labels: DataFrame, **options) -> DataFrame:
    kept: list[DataFrame] = []
    with scope(feats.sparkSession, kept):
        feats = materialise(feats, "quality-features")
        cuts = materialise(thresholds(feats, labels, **options), "quality-cuts")
        kept += [feats, cuts]
        return verdict(feats, cuts)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns only.

    Texts are stored beside their statistics: both are read or written once more, and never shuffled.
    """
    packed = spread(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_d"), F.col("doc_id"), F.col("text"), F.col("lang")))
    return _judged(features(packed).drop("text"), labels, **options).where("kept").select("_d.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
