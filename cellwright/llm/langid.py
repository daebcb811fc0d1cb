"""Language identification with spans: script ranges, word scores, Viterbi.

Fitting counts hashed byte trigrams (word borders included) and the scripts of
words per language, over a bounded sample of the labelled rows: at most about
``rows_per_language`` documents of each language, chosen by hash. A word's
script leaves the languages that use it; among these, its trigrams give a
log-likelihood per language. Viterbi with a fixed penalty for each switch then
labels every word, and runs of a label are spans. The document's language is the
label of most words; its score is that share of the words.

Defined results: null text, or text without letters, is ``und`` with score 0 and
no spans; ties go to the first language in order; rows with a null label or id
are never learned from; repeated rows are labelled each; an empty table gives an
empty result; without any labelled row everything is ``und``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import arrow_batches, spread

ROWS_PER_LANGUAGE = 2_000
SWITCH_PENALTY = 9.0
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: A language uses a script if this share of its words does.
SCRIPT_SHARE = 0.005
CHUNK_CHARS = 1 << 20

# Unicode ranges of scripts (first and last code point).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
#: ASCII letters to lower case, all other ASCII to blanks.
_PLAIN = bytes((c | 32) if 65 <= (c & ~32) <= 90 and c < 128 else c if c >= 128 else 32 for c in range(256))


def _script_table() -> np.ndarray:
    """Script's number (from 1; 0: none or unknown) by the first two UTF-8 bytes of a character."""
    table = np.zeros(1 << 16, np.uint8)
    table[97 << 8: (122 << 8) + 256] = 1
    for number, (_, first, last) in enumerate(SCRIPTS, 1):
        for cp in range(max(first, 0x80), last + 1):
            b = chr(cp).encode("utf-8", "surrogatepass")
            table[b[0] << 8 | b[1]] = number
    return table


_TABLE: list[np.ndarray] = []


class _Blanks(dict):
    """For str.translate: other characters than ASCII, letters and their marks become blanks."""

    def __missing__(self, code: int) -> int:
        self[code] = code if code < 128 or unicodedata.category(chr(code))[0] in "LM" else 32
        return self[code]


_BLANKS = _Blanks()


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode L*); number forms such as \u00b2 or \u2167 are none."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def _coded(text: str) -> bytes:
    lower = text.lower()
    if _NOT_ASCII.search(lower):
        lower = lower.translate(_BLANKS)
    return lower.encode("utf-8", "surrogatepass").translate(_PLAIN)


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts together: trigram bucket by byte, words' first bytes, words' scripts, words' texts, words' ends."""
    if not _TABLE:
        _TABLE.append(_script_table())
    coded = [_coded(t) for t in texts]
    b = np.frombuffer(b" " + b" ".join(coded) + b"  ", np.uint8)
    ends_of_texts = np.cumsum([len(c) + 1 for c in coded])
    letter = b != 32
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    x = b.astype(np.uint32)
    gram = np.full(len(b), BUCKETS, np.uint32)  # by the middle byte; blanks have the neutral bucket
    gram[1:-1] = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    gram[~letter] = BUCKETS
    if len(starts) == 0:
        return gram, starts, starts.astype(np.uint8), starts, ends
    pair = np.zeros(len(b), np.uint8)
    pair[:-1] = _TABLE[0][(x[:-1] << 8 | x[1:])]
    script = np.maximum.reduceat(pair, starts)
    return gram, starts, script, np.searchsorted(ends_of_texts, starts, "right"), ends


def _count(languages: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BUCKETS + 1 + len(SCRIPTS) + 1
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang, text in zip(langs, texts):
                c = counts.setdefault(languages[lang], np.zeros(width, np.int64))
                gram, _, script, _, _ = word_features([text.as_py()])
                c[: BUCKETS + 1] += np.bincount(gram, minlength=BUCKETS + 1)
                c[BUCKETS + 1:] += np.bincount(script, minlength=len(SCRIPTS) + 1)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["k", "slot", "n"])

    return run


def fit(docs: DataFrame, learn: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """A model from the rows where ``learn`` holds and the label isn't null. Its size depends on the languages only."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = sorted(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.lang)  # one row a language
    if not known:
        return {"languages": []}
    languages = {r.lang: k for k, r in enumerate(known)}
    share = F.element_at(F.create_map(*[x for r in known for x in (F.lit(r.lang), F.lit(min(1.0, rows_per_language / r.n)))]), F.col("lang"))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    arrow_batches(docs.sparkSession)
    counted = rows.where(place < share).select("lang", "text").mapInArrow(_count(languages), "k int, slot int, n bigint")
    width = BUCKETS + 1 + len(SCRIPTS) + 1
    counts = np.zeros((len(languages), width))
    summed = counted.groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages x slots rows
    counts[summed["k"].to_numpy(), summed["slot"].to_numpy()] = summed["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS] + SMOOTHING, counts[:, BUCKETS + 1:]
    score = np.log(grams / grams.sum(1, keepdims=True))
    score -= score.mean(0)
    uses = (scripts / np.maximum(1, scripts.sum(1, keepdims=True))) >= SCRIPT_SHARE
    return {
        "languages": list(languages),
        "score": np.vstack([score.T, np.zeros((1, len(languages)))]).astype(np.float32),
        # a word in a script that some languages use rules the others out; in any other it says nothing
        "script": np.where(uses.any(0)[:, None], np.where(uses.T, 0.0, -60.0), 0.0).astype(np.float32),
        "silent": ~uses.any(0),
    }


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every word. ``scores``: words x languages, texts after one another; all texts advance together."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    length = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    n = int((length > 0).sum())
    if n == 0:
        return labels
    steps = int(length[0])
    active = np.searchsorted(-length[:n], -np.arange(steps), "left")  # texts longer than the step
    stay = np.ones(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    value = scores[first[:n]].copy()
    for t in range(1, steps):
        a = active[t]
        v, at = value[:a], first[:a] + t
        top = v.argmax(1)
        jump = v[np.arange(a), top] - penalty
        keeps = v >= jump[:, None]
        source[at], stay[at] = top, keeps
        value[:a] = np.where(keeps, v, jump[:, None]) + scores[at]
    state = value.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        labels[at] = state[:a]
        state[:a] = np.where(stay[at, state[:a]], state[:a], source[at])
    return labels


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))


def label_texts(texts: list[str | None], model: dict, penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; a span is (first word, words, language), words being runs of letters."""
    languages = model["languages"]
    told = [k for k, t in enumerate(texts) if languages and t and has_letter(t)]
    scores, lengths = [np.zeros((0, len(languages)), np.float32)], np.zeros(len(told), np.int64)
    k = 0
    while k < len(told):  # features take many bytes a character: in chunks
        m, chars = k, 0
        while m < len(told) and (m == k or chars < CHUNK_CHARS):
            chars += len(texts[told[m]])
            m += 1
        gram, starts, script, of, _ = word_features([texts[x] for x in told[k:m]])
        if len(starts):
            s = np.add.reduceat(model["score"][gram], starts, axis=0)
            s[model["silent"][script]] = 0
            scores.append(s + model["script"][script])
            lengths[k:m] = np.bincount(of, minlength=m - k)
        k = m
    labels = viterbi(np.concatenate(scores), lengths, penalty)
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = [("und", 0.0, [])] * len(texts)
    at = 0
    for k, n in zip(told, lengths.tolist()):
        mine = labels[at: at + n]
        at += n
        if n:
            votes = np.bincount(mine, minlength=len(languages))
            cuts = np.concatenate(([0], np.flatnonzero(mine[1:] != mine[:-1]) + 1, [n])).tolist()
            best = int(votes.argmax())
            out[k] = (languages[best], float(votes[best]) / n, [(a, b - a, languages[mine[a]]) for a, b in zip(cuts, cuts[1:])])
    return out


def label(docs: DataFrame, model: dict, penalty: float = SWITCH_PENALTY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and spans of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the languages
    arrow_batches(spark)
    src = spread(docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias("_text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_text").schema)
    schema = f"{kept}, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = label_texts(b.column(b.num_columns - 1).to_pylist(), shared.value, penalty)
            spans = [[{"start": s, "words": n, "lang": x} for s, n, x in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, _SPANS)],
                [*b.schema.names[:-1], "lang_pred", "score", "spans"])

    return src.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, ~held_out(F.col("doc_id")))
    rows = label(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
