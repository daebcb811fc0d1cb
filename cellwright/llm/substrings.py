"""Substring dedup: words inside windows that start twice or more in the corpus.

Every window of ``window`` words has an anchor, the smallest-hash run of
``ANCHOR`` words in it (the leftmost of equals). Equal windows have equal
anchors at equal offsets, so an anchor occurs at least as often as any window it
stands for. The first pass counts anchors in a count-min sketch per partition;
the sketches are merged (cells saturate at two). The second pass takes the windows
whose anchor the merged sketch estimates to occur twice, and only these are
grouped exactly, by 96 hash bits. The sketch overestimates, so no repeated window
is lost. It is sized by the text, about four cells an anchor.

A merged sketch of up to ``SHARED_CELLS`` cells a row is broadcast, as bits. A
larger one never leaves the executors: partition sketches are sparse rows (cell,
count), merged by an aggregate; documents are joined with the cells that they
have and that count two. Both ways suspect the same windows but for chance.

A part of the corpus (some thousand documents of one task) sends each distinct
window once, with whether it has it twice itself, and gets back the numbers of
its repeated windows. So even a window that a third of all documents share makes
few rows, and the exact grouping takes one shuffle.

Defined results: null or blank text has no words; texts shorter than a window
lose nothing; repeated rows are copies of each other; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import WordHashes, arrow_batches, mix64, small_side, spread
from cellwright.sources.scratch import materialise, scope

WINDOW = 35
ANCHOR = 16
SKETCH_ROWS = 2
LEAST_CELLS = 1 << 22
#: Cells a row up to which the merged sketch is broadcast: 16 MB a row.
SHARED_CELLS = 1 << 27
#: Bits of a cell's number in the sketch that stays on the executors.
WIDE = 48
#: Cells in a block of the sketch, the unit of merging.
BLOCK = 1 << 18
CHUNK_WORDS = 200_000

_B1, _B2 = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F  # odd
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) <= n:
        size = max(2 * n, 1 << 18) + 1
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        got = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return got


def rolling(h: np.ndarray, size: int, base: int = _B1) -> np.ndarray:
    """Hash of every run of ``size`` word hashes."""
    up, down = _powers(base, len(h))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
    return mix64((sums[size:] - sums[:-size]) * down[: len(h) - size + 1])


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of each ``width`` neighbours."""
    value, index, reach = x, np.arange(len(x)), 1
    while reach < width:
        step = min(reach, width - reach)
        left = value[:-step] <= value[step:]
        value, index = np.where(left, value[:-step], value[step:]), np.where(left, index[:-step], index[step:])
        reach += step
    return index


class Chunk:
    """Some documents' words, one after another, with their windows and anchors."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes, window: int, anchor: int):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.h = np.concatenate([hashes.of(w) for w in words]) if words else np.zeros(0, np.uint64)
        ends = np.cumsum(self.lengths)
        self.firsts = ends - self.lengths
        n = len(self.h) - window + 1
        self.starts = self.anchor_hash = self.anchor_at = np.zeros(0, np.int64)
        if n <= 0 or self.lengths.max() < window:
            self.anchor_of = np.zeros(0, np.int64)
            return
        grams = rolling(self.h, anchor)
        best = leftmost_minima(grams, window - anchor + 1)[:n]
        inside = np.zeros(n + window, np.int64)  # windows that don't leave their document
        long = self.lengths >= window
        np.add.at(inside, self.firsts[long], 1)
        np.add.at(inside, ends[long] - window + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(inside)[:n])
        self.anchor_at, self.anchor_of = np.unique(best[self.starts], return_inverse=True)
        self.anchor_hash = grams[self.anchor_at]

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The documents in which words stand."""
        return np.searchsorted(self.firsts + self.lengths, places, "right")


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    return [((h if r == 0 else mix64(h + np.uint64(r))) >> np.uint64(20)) & np.uint64(cells - 1) for r in range(SKETCH_ROWS)]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, words, n = 0, [], 0
    for i, t in enumerate(texts):
        w = t.split() if t else []
        words.append(w)
        n += len(w)
        if n >= CHUNK_WORDS:
            yield first, words
            first, words, n = i + 1, [], 0
    if words:
        yield first, words


_PIECE = "block int, ones binary, twos binary"
_PIECE_PA = pa.schema([("block", pa.int32()), ("ones", pa.binary()), ("twos", pa.binary())])


def _sketch(window: int, anchor: int, cells: int):
    """Partition sketches, a few million anchors each, as blocks: sorted offsets of the cells seen once and of those seen again."""

    def pieces(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row, part in enumerate(parts):
            cell, count = np.unique(np.concatenate(part), return_counts=True)
            block = (cell // BLOCK).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            low, again = (cell % BLOCK).astype(np.uint32), count > 1
            at = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([
                pa.array([row * (cells // BLOCK) + int(block[a]) for a, _ in at], pa.int32()),
                pa.array([low[a:b][~again[a:b]].tobytes() for a, b in at], pa.binary()), pa.array([low[a:b][again[a:b]].tobytes() for a, b in at], pa.binary()),
            ], schema=_PIECE_PA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, n = WordHashes(), [[] for _ in range(SKETCH_ROWS)], 0
        for b in batches:
            for _, words in _chunks(b.column(0).cast(pa.binary()).to_pylist()):
                c = Chunk(words, hashes, window, anchor)
                for row, cell in enumerate(_cells(c.anchor_hash.astype(np.uint64), cells)):
                    parts[row].append(cell.astype(np.uint32))
                n += len(c.anchor_hash)
            if n > 2_000_000:
                yield from pieces(parts)
                parts, n = [[] for _ in range(SKETCH_ROWS)], 0
        if n:
            yield from pieces(parts)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saturating sums of the pieces of each block: bits of the cells that count two or more."""
    one: dict[int, np.ndarray] = {}
    two: dict[int, np.ndarray] = {}
    for b in batches:
        for block, ones, twos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            seen = one.setdefault(block, np.zeros(BLOCK, bool))
            again = two.setdefault(block, np.zeros(BLOCK, bool))
            o, t = np.frombuffer(ones, np.uint32), np.frombuffer(twos, np.uint32)
            again[o[seen[o]]] = True
            again[t] = True
            seen[o] = True
            seen[t] = True
    for block in one:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(two[block]).tobytes()], pa.binary())], ["block", "bits"])


def cells_for(docs: DataFrame) -> int:
    """Cells a row for the text of ``docs``, about four an anchor: a power of two."""
    chars = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(LEAST_CELLS, 1 << (int(chars) // 15).bit_length())


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, anchor: int = ANCHOR) -> bytes:
    """The bits (a row after another) of the merged sketch of at most ``SHARED_CELLS`` cells a row, on the driver: 32 MB at most."""
    if cells > SHARED_CELLS:
        raise ValueError("too many cells to share")
    made = spread(docs.select(docs["text"].cast("string").alias("text"))).mapInArrow(_sketch(window, anchor, cells), _PIECE)
    merged = made.repartition(F.col("block")).mapInArrow(_merge, "block int, bits binary")
    bits = np.zeros((SKETCH_ROWS * cells // BLOCK, BLOCK // 8), np.uint8)
    for r in merged.collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.tobytes()


def _wide(h: np.ndarray) -> np.ndarray:
    return (mix64(h.astype(np.uint64)) >> np.uint64(64 - WIDE)).astype(np.int64)


def _sparse(window: int, anchor: int):
    """(doc_id, th, cell, n): each document's cells and their counts, for (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, ths = b.column(0), b.column(1)
            for first, words in _chunks(b.column(2).cast(pa.binary()).to_pylist()):
                c = Chunk(words, hashes, window, anchor)
                if len(c.anchor_at):
                    both, n = np.unique(np.stack([c.documents(c.anchor_at), _wide(c.anchor_hash)]), axis=1, return_counts=True)
                    at = pa.array(both[0] + first)
                    yield pa.RecordBatch.from_arrays([ids.take(at), ths.take(at), pa.array(both[1]), pa.array(np.minimum(n, 2).astype(np.int32))], ["doc_id", "th", "cell", "n"])

    return run


def repeated_cells(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, cells): the cells of each different document that the merged sketch counts twice or more, stored."""
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        sparse = materialise(spread(docs).mapInArrow(_sparse(window, anchor), "doc_id bigint, th bigint, cell bigint, n int"), "substring-sketch")
        twice = sparse.groupBy(F.col("cell").alias("_c")).agg(F.sum("n").alias("total")).where("total > 1")
        mine = sparse.join(twice, F.col("cell") == F.col("_c")).groupBy("doc_id", "th").agg(F.collect_set("cell").alias("cells"))
        kept.append(materialise(mine, "substring-cells"))
    return kept[0]


#: Suspected windows and documents after which a task starts a new part.
PART_WINDOWS, PART_ROWS = 1 << 18, 4_000
_ROW = "part bigint, doc_id bigint, th bigint, pos array<int>, win array<int>, len array<int>, h array<bigint>, more array<int>"
_ROW_PA = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("pos", "win", "len")], ("h", pa.list_(pa.int64())), ("more", pa.list_(pa.int32()))])


class _Part:
    """The suspected windows of some documents, numbered by first occurrence, so that repeated passages are runs of numbers."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []  # doc_id, hash of the text, starts of suspected windows
        self.h1: list[np.ndarray] = []
        self.h2: list[np.ndarray] = []
        self.windows = 0

    def batches(self, part: int) -> Iterator[pa.RecordBatch]:
        """A row with the distinct windows (only if there are any), then the documents with their windows as runs."""
        number = np.zeros(0, np.int64)
        if self.windows:
            h1, h2 = np.concatenate(self.h1), np.concatenate(self.h2)
            order = np.lexsort((h2, h1))  # stable: a group starts with its first occurrence
            new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
            firsts = np.flatnonzero(new)
            rank = np.empty(len(firsts), np.int64)
            rank[np.argsort(order[firsts])] = np.arange(len(firsts))
            number = np.empty(self.windows, np.int64)
            number[order] = rank[np.cumsum(new) - 1]
            by_rank = np.argsort(rank)
            first, twice = order[firsts][by_rank], (np.diff(np.append(firsts, self.windows)) > 1)[by_rank]
            # more: 31 further hash bits, and whether this part alone has the window twice
            more = (h2[first].astype(np.int64) >> 1 << 1 | twice).astype(np.uint32).view(np.int32)
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            nothing = [pa.array([None], f.type) for f in _ROW_PA]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *nothing[1:6], one(h1[first], pa.int64()), one(more, pa.int32())], schema=_ROW_PA)
        at = 0
        for k in range(0, len(self.rows), 500):
            rows = self.rows[k: k + 500]
            counts = np.array([len(r[2]) for r in rows])
            pos, win = np.concatenate([r[2] for r in rows]), number[at: at + int(counts.sum())]
            at += len(pos)
            of = np.repeat(np.arange(len(rows)), counts)
            cut = np.flatnonzero(np.concatenate(([True], (np.diff(pos) != 1) | (np.diff(win) != 1) | (np.diff(of) != 0))))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[cut], minlength=len(rows))))), pa.int32())
            runs = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pos[cut], win[cut], np.diff(np.append(cut, len(pos))))]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *runs,
                pa.nulls(len(rows), pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int32())),
            ], schema=_ROW_PA)


def _by_bits(shared):
    """Tells the anchors of a chunk that a broadcast sketch counts twice."""

    def repeated(c: Chunk, answers: list | None) -> np.ndarray:
        cells, packed = shared.value
        bits = np.frombuffer(packed, np.uint8).reshape(SKETCH_ROWS, cells // 8)
        out = np.ones(len(c.anchor_hash), bool)
        for row, cell in enumerate(_cells(c.anchor_hash.astype(np.uint64), cells)):
            out &= (bits[row][cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
        return out

    return repeated


def _by_cells(c: Chunk, answers: list[list[int]]) -> np.ndarray:
    """Tells the anchors of a chunk whose cells are among the repeated ones of their documents."""
    out, cell, of = np.zeros(len(c.anchor_hash), bool), _wide(c.anchor_hash), c.documents(c.anchor_at)
    cuts = np.searchsorted(of, np.arange(len(answers) + 1))
    for k, mine in enumerate(answers):
        lo, hi = cuts[k], cuts[k + 1]
        if hi > lo:
            out[lo:hi] = np.isin(cell[lo:hi], np.array(mine, np.int64))
    return out


def _suspects(repeated, window: int, anchor: int):
    """Parts of documents (rid, doc_id, th, text and maybe cells) with the windows that the sketch estimates repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, name = WordHashes(), _Part(), None
        for b in batches:
            if not b.num_rows:
                continue
            (rids, ids, ths), raw = (b.column(k).to_pylist() for k in range(3)), b.column(3).cast(pa.binary()).to_pylist()
            answers = b.column(4).to_pylist() if b.num_columns > 4 else None
            for first, words in _chunks(raw):
                c = Chunk(words, hashes, window, anchor)
                again = repeated(c, answers and answers[first: first + len(words)])
                starts = c.starts[again[c.anchor_of]] if len(c.starts) else c.starts
                of = c.documents(starts)
                counts = np.bincount(of, minlength=len(words))
                each = np.split(starts - c.firsts[of], np.cumsum(counts)[:-1])
                name = rids[first] if name is None else name
                part.rows += [(ids[first + i], ths[first + i], each[i]) for i in np.flatnonzero(counts).tolist()]
                if len(starts):
                    part.h1.append(rolling(c.h, window)[starts].view(np.int64))
                    part.h2.append((rolling(c.h, window, _B2)[starts] >> np.uint64(32)).astype(np.uint32))
                    part.windows += len(starts)
                if part.windows >= PART_WINDOWS or len(part.rows) >= PART_ROWS:
                    yield from part.batches(name)
                    part, name = _Part(), None
        if part.rows:
            yield from part.batches(name)

    return run


def _ranges(window: int):
    """Streams parts sorted so that a part's repeated windows come before its documents; gives the word ranges to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, repeated = None, np.zeros(0, bool)
        for b in batches:
            keep, firsts, lasts = [], [], []
            for i, (part, numbers) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                if part != at:
                    at, repeated = part, np.zeros(0, bool)
                if numbers.is_valid:  # the part's repeated windows
                    found = numbers.values.to_numpy()
                    repeated = np.zeros(int(found.max()) + 1, bool)
                    repeated[found] = True
                    continue
                runs = zip(*(b.column(k)[i].values.to_pylist() for k in (5, 6, 7)))
                starts = np.concatenate([np.flatnonzero(repeated[first: first + n]) + start for start, first, n in runs])
                if len(starts):
                    starts.sort()
                    gap = np.flatnonzero(np.diff(starts) > window)  # windows that touch are one range
                    keep.append(i)
                    firsts.append(starts[np.concatenate(([0], gap + 1))].tolist())
                    lasts.append((starts[np.append(gap, len(starts) - 1)] + window).tolist())
            rows = b.take(pa.array(keep, pa.int64()))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), pa.array(firsts, kind), pa.array(lasts, kind)], ["doc_id", "th", "first", "last"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, removed, shas = [], [], []
        for text, first, last in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            w = text.split() if text else []
            n_words.append(len(w))
            if first:
                for s, e in zip(reversed(first), reversed(last)):
                    del w[s:e]
            removed.append(n_words[-1] - len(w))
            shas.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, first, last) of each different document that loses words, stored; th: hash of the text; first, last: arrays of word ranges, the end exclusive."""
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        kept.append(_ranges_of(docs, window, anchor))
    return kept[0]


def _suspected(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The parts with their suspected windows (see ``_ROW``), stored."""
    spark = docs.sparkSession
    arrow_batches(spark)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].cast("string").alias("text"))
    cells = cells_for(keyed)
    numbered = lambda df: df.withColumn("rid", F.monotonically_increasing_id())
    if cells <= SHARED_CELLS:
        shared = spark.sparkContext.broadcast((cells, sketch(keyed, cells, window, anchor)))
        src, repeated = numbered(spread(keyed)).select("rid", "doc_id", "th", "text"), _by_bits(shared)
    else:
        mine = small_side(repeated_cells(keyed, window, anchor).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "cells"))
        src = keyed.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
        src, repeated = numbered(src).select("rid", "doc_id", "th", "text", "cells"), _by_cells
    return materialise(src.mapInArrow(_suspects(repeated, window, anchor), _ROW), "substring-rows")


def _ranges_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    rows = _suspected(docs, window, anchor)
    # a part sends each window once, so a window of very many documents has a row a part, not a document
    each = rows.where(F.col("h").isNotNull()).select("part", F.posexplode(F.arrays_zip("h", "more")).alias("number", "w")).select("part", "number", "w.h", "w.more")
    weight = F.sum(F.col("more").bitwiseAND(1) + 1).over(Window.partitionBy("h", F.shiftright("more", 1)))
    found = each.withColumn("n", weight).where("n > 1").groupBy("part").agg(F.collect_list("number").alias("numbers"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    runs = ("pos", "win", "len")
    found = found.select("part", F.lit(0).alias("role"), "numbers", none("bigint", "doc_id"), none("bigint", "th"), *[none("array<int>", c) for c in runs])
    marked = rows.where(F.col("h").isNull()).select("part", F.lit(1).alias("role"), none("array<int>", "numbers"), "doc_id", "th", *runs)
    both = found.unionByName(marked).repartition("part").sortWithinPartitions("part", "role")
    ranges = both.mapInArrow(_ranges(window), "doc_id bigint, th bigint, first array<int>, last array<int>")
    return materialise(ranges.dropDuplicates(["doc_id", "th"]), "substring-ranges")  # equal rows lose the same words


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    ranges = repeated_ranges(docs, window, anchor)
    side = small_side(ranges.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "first", "last"))
    texts = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.xxhash64(docs["text"]).alias("th")))
    cut = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("doc_id", "text", "first", "last")
    return cut.mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
