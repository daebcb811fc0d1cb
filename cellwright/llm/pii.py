"""Personal data: base patterns, then bootstrapped contextual extraction.

One scan of every text finds the base identifiers (e-mail and IP addresses, card
and phone numbers) and all other identifier-like tokens, each with its lexical
contexts: the word before, the two words before, the words on either side. A
context word is a run of letters, digits and _ outside the identifier, in lower
case and with its digits alike; nothing is cut.

The base identifiers are the seeds. Spark then scores the graph of patterns (a
context) and instances (token values) in turns: a pattern is as good, for a kind,
as the share of its distinct instances that are known to be of the kind, given
``min_support`` of them; an instance is as good as the noisy-or of its patterns.
Tokens whose score passes ``min_score`` become known for the next turn, with
their score as weight, and are scored anew there; seeds stay. In the end the
occurrences of what was found become spans too.

Defined results: null or empty text has no spans; base spans always stay, and
added spans never overlap them; repeated rows are scanned each; ties go to the
first kind listed; an empty table gives an empty result; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import arrow_batches, spread
from cellwright.sources.scratch import materialise, scope

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 2
MIN_SUPPORT = 3
MIN_SCORE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always starts at the start of a run of digits: the look-behind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An identifier-like token: a run of identifier characters, less punctuation at its ends.
_RUN = re.compile(r"[A-Za-z0-9@._+()/-]{5,}+")
_ENDS = "@._+()/-"
_WORDS = re.compile(r"\w+")


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base identifiers, sorted."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) is not None:
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def _h(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Contexts:
    """The patterns of spans of one text; its words are found once, when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None

    def _word(self, k: int) -> str:
        return _DIGIT.sub("0", self.text[self.starts[k]:self.ends[k]].lower())

    def patterns(self, start: int, end: int) -> list[int]:
        if self.starts is None:
            at = [m.span() for m in _WORDS.finditer(self.text)]
            self.starts, self.ends = [a for a, _ in at], [b for _, b in at]
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)  # words before and after the span, whole
        out = []
        if before:
            last = self._word(before - 1)
            out.append("1 " + last)
            if before > 1:
                out.append(f"2 {self._word(before - 2)} {last}")
            if after < len(self.starts):
                out.append(f"b {last} {self._word(after)}")
        return list(map(_h, out))


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base identifiers (seed: the kind's index) and other identifier-like tokens (seed -1) with their patterns."""
    near = _Contexts(text)
    out = [{"start": s, "end": e, "seed": k, "inst": _h(text[s:e].lower()), "pats": near.patterns(s, e)} for s, k, e in base]
    taken, i = sorted((s, e) for s, _, e in base), 0
    if not (_DIGIT.search(text) or "@" in text):
        return out
    for m in _RUN.finditer(text):
        token = m[0].rstrip(_ENDS)
        end = m.start() + len(token)
        token = token.lstrip(_ENDS)
        start = end - len(token)
        if len(token) < 5 or "@" not in token and sum("0" <= c <= "9" for c in token) < 4:
            continue
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        out.append({"start": start, "end": end, "seed": -1, "inst": _h(token.lower()), "pats": near.patterns(start, end)})
    return out


_OCC = "array<struct<start:int,end:int,seed:int,inst:bigint,pats:array<bigint>>>"
_SCAN = f"rid bigint, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, occ {_OCC}"
_OCC_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))]))
_BASE_PA = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        shas, bases, occs = [], [], []
        for text in b.column(2):
            text = text.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            occs.append(occurrences(text, base))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(bases, _BASE_PA), pa.array(occs, _OCC_PA)],
            ["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "occ"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored scan of every row: base counts, spans, and all occurrences with their patterns; ``rid`` tells rows apart."""
    arrow_batches(docs.sparkSession)
    src = spread(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")))
    src = src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return materialise(src.mapInArrow(_scan, _SCAN), "pii-scan")


def discover(scanned: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """(inst, kind, score) of the unseen identifiers that high-confidence patterns find, stored."""
    kept: list[DataFrame] = []
    with scope(scanned.sparkSession, kept):
        occ = scanned.select(F.explode("occ").alias("o")).select("o.inst", "o.seed", F.explode("o.pats").alias("pat"))
        # seed of an instance: the first listed kind under which any occurrence is a base identifier
        edges = occ.groupBy("pat", "inst").agg(F.min(F.when(F.col("seed") >= 0, F.col("seed"))).alias("seed"))
        edges = materialise(edges, "pii-edges")
        seeds = materialise(edges.where("seed is not null").groupBy("inst").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("weight")), "pii-seeds")
        is_seed = seeds.select(F.col("inst").alias("_i"))
        known, found = seeds, None
        for _ in range(rounds):
            # a pattern's confidence per kind: weight of its known instances over all its instances, each counted once
            rated = edges.join(known.withColumnRenamed("inst", "_i"), F.col("inst") == F.col("_i"), "left")
            sums = rated.groupBy("pat").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(f"w{k}") for k in range(len(KINDS))])
            best = F.greatest(*[F.col(f"w{k}") for k in range(len(KINDS))])
            first = F.coalesce(*[F.when(F.col(f"w{k}") == best, F.lit(k)) for k in range(len(KINDS))])
            pats = sums.where(best >= min_support).select(F.col("pat").alias("_p"), first.alias("pk"), (best / (F.col("n") + 0.5)).alias("conf"))
            scored = edges.join(pats, F.col("pat") == F.col("_p")).groupBy("inst", "pk").agg(F.sum(F.log1p(-F.col("conf"))).alias("ll"))
            scored = scored.join(is_seed, F.col("inst") == F.col("_i"), "left_anti").select("inst", F.struct((1 - F.exp("ll")).alias("s"), (-F.col("pk")).alias("k")).alias("v"))
            scored = scored.groupBy("inst").agg(F.max("v").alias("v")).where(F.col("v.s") >= min_score)
            found = materialise(scored.select("inst", (-F.col("v.k")).alias("kind"), F.col("v.s").alias("weight")), "pii-found")
            known = seeds.unionByName(found)
        kept.append(found)
    return found.select("inst", "kind", F.col("weight").alias("score"))


def _span(x: Column) -> Column:
    return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, base counts and hash, and ``found``: all spans as (start, kind, end), base and discovered."""
    scanned = scan(docs, doc_id, text)
    new = discover(scanned, **options).select("inst", "kind")
    occ = scanned.select("rid", F.explode(F.filter("occ", lambda o: o["seed"] < 0)).alias("o")).select("rid", "o.start", "o.end", "o.inst")
    more = occ.join(new, "inst").groupBy(F.col("rid").alias("_r")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    rows = scanned.join(more, F.col("rid") == F.col("_r"), "left")
    found = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", found.alias("found"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [f"n_{k}" for k in KINDS]
    n_spans = F.size("found").cast("long")
    return rows.select("doc_id", *counts, "base_sha256", F.array_join(F.transform("found", _span), ",").alias("spans"), n_spans.alias("n_spans"), (n_spans - sum(map(F.col, counts))).alias("n_added"))
