"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct word shingles (lower-cased A-Z). Documents
of equal sets form a class. Each class has a MinHash signature, cut into the
labels of ``TREES`` trees. A tree is the order of all classes by label, range
partitioned; a class's candidates are its neighbours there while they share a
prefix of ``LEAST_DEPTH`` values or more: in crowded regions the nearest share
longer prefixes, so the depth adapts to the region. Candidates whose signatures
agree too little are dropped; the threshold lies four standard errors below the
similarity asked for.

Links are confirmed on full sets, in a fixed number of passes:

* candidates are clustered once, and each class is compared with its cluster's
  centre, which connects groups of copies of one text at a text a class;
* the crowd: classes in prefix runs longer than the neighbours of one class
  reach, unless the centres have connected the whole run. Among these, rare
  shingles tell exactly who can be similar to anyone: with a class's shingles in
  order of how many classes of the crowd have them, two similar sets share one
  early in both orders, so what a template shares never meets. What meets is
  compared in blocks, but for pairs that are connected already;
* all other candidates whose ends are still apart are compared themselves.

Connected components of the confirmed links, by contraction, give the result.

Defined results: null or blank text has no shingles and is linked with nothing;
shorter texts are one shingle; a null id never becomes a component's id unless
all ids are null; repeated rows are linked to each other; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import WordHashes, arrow_batches, mix64, small_side, spread
from cellwright.llm.components import components
from cellwright.llm.substrings import rolling
from cellwright.sources.scratch import materialise, scope

#: Words of a shingle: of the op3 query, and of a filtering stage.
SHINGLE, STAGE_SHINGLE = 4, 5
PERCENT = 80
TREES = 16
DEPTH = 8
LEAST_DEPTH = 3
NEIGHBOURS = 6
#: Documents compared with one copy of a centre's text.
COMPARED = 32
CHUNK_WORDS = 200_000
#: Shingles in an Arrow batch.
BATCH_SHINGLES = 500_000
#: Classes, and shingles, of a block of a crowd on average at most; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 1_024, 1 << 20

_K = TREES * DEPTH
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1 << 32, size=_K, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(1 << 32, size=_K, dtype=np.uint32)


def shingle_sets(texts: list[bytes | None], hashes: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        words, n = [], 0
        while first + len(words) < len(texts) and n < CHUNK_WORDS:
            t = texts[first + len(words)]
            words.append(t.lower().split() if t else [])
            n += len(words[-1])
        h = np.concatenate([hashes.of(w) for w in words])
        grams = rolling(h, size) if len(h) >= size else np.zeros(0, np.uint64)
        at = 0
        for w in words:
            if len(w) >= size:
                out.append(np.unique(grams[at: at + len(w) - size + 1]))
            elif w:
                out.append(np.array([xxhash.xxh3_64_intdigest(b"%d " % len(w) + b" ".join(w))], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += len(w)
        first += len(words)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the minima, sets x functions; no set is empty."""
    x = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([(np.minimum.reduceat((x ^ b) * a, starts) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16) for a, b in zip(_MUL, _XOR)], 1)


_ROW = "rid bigint, doc_id bigint, th bigint, n bigint, s1 bigint, s2 bigint, sig binary"


def _summarise(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            yield _summary(b, shingle_sets(b.column(3).cast(pa.binary()).to_pylist(), hashes, size))

    return run


def _summary(b: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    full = [s for s in sets if len(s)]
    sigs: list[bytes] = []
    k = 0
    while k < len(full):
        m, n = k, 0
        while m < len(full) and n < CHUNK_WORDS:
            n += len(full[m])
            m += 1
        sigs += [r.tobytes() for r in signatures(full[k:m])]
        k = m
    each = iter(sigs)
    ids = np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed=k) for k in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [*b.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([next(each) if len(s) else None for s in sets], pa.binary())],
        ["rid", "doc_id", "th", "n", "s1", "s2", "sig"])


def _neighbours(depth: int, least: int, reach: int):
    """Pairs (a, b) of neighbours, and the runs (tree, prefix) they may not cover: longer ones, and a partition's first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key, rows, first = None, None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            tree, cid, n = (b.column(i).to_numpy() for i in (0, 2, 3))
            label = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, depth)
            starts = np.flatnonzero(np.concatenate([[True], (label[1:, :least] != label[:-1, :least]).any(1) | (tree[1:] != tree[:-1])]))
            lengths = np.diff(starts, append=len(cid))
            name = lambda k: (int(tree[starts[k]]), label[starts[k], :least].astype(">u2").tobytes())  # noqa: B023, E731
            runs = []
            if name(0) == key:
                rows += int(lengths[0])
            else:
                if key is not None and (first or rows > reach + 1):
                    runs.append(key)
                first, key, rows = key is None, name(0), int(lengths[0])
            if len(starts) > 1:
                if first or rows > reach + 1:
                    runs.append(key)
                runs += [name(k) for k in np.flatnonzero(lengths[1:-1] > reach + 1) + 1]
                first, key, rows = False, name(len(starts) - 1), int(lengths[-1])
            old = 0
            if kept is not None:
                old = len(kept[0])
                tree, label, cid, n = (np.concatenate(x) for x in zip(kept, (tree, label, cid, n)))
            pairs = [(np.zeros(0, np.int64),) * 2]
            for j in range(1, min(reach, len(cid) - 1) + 1):
                near = (label[j:, :least] == label[:-j, :least]).all(1) & (tree[j:] == tree[:-j])
                near &= 100 * np.minimum(n[j:], n[:-j]) >= PERCENT * np.maximum(n[j:], n[:-j])
                near[: max(0, old - j)] = False  # seen with the last batch
                i = np.flatnonzero(near)
                pairs.append((np.minimum(cid[i], cid[i + j]), np.maximum(cid[i], cid[i + j])))
            kept = tree[-reach:], label[-reach:], cid[-reach:], n[-reach:]
            yield _pairs_and_runs(np.unique(np.stack([np.concatenate([p[k] for p in pairs]) for k in (0, 1)], 1), axis=0), runs)
        if key is not None:
            yield _pairs_and_runs(np.zeros((0, 2), np.int64), [key])

    return run


def _pairs_and_runs(both: np.ndarray, runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    p, r = [None] * len(both), [None] * len(runs)
    return pa.RecordBatch.from_arrays(
        [pa.array(both[:, 0].tolist() + r, pa.int64()), pa.array(both[:, 1].tolist() + r, pa.int64()), pa.array(p + [t for t, _ in runs], pa.int32()), pa.array(p + [x for _, x in runs], pa.binary())],
        ["a", "b", "tree", "prefix"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, _K) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x == y).mean(1))], ["a", "b", "agree"])


def _compare(size: int, percent: int):
    """Streams (centre, salt, role, cid, text) sorted so; the centre's text comes first in its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, centre = WordHashes(), None, None
        for b in batches:
            sets = shingle_sets(b.column(4).cast(pa.binary()).to_pylist(), hashes, size)
            out: list[tuple[int, int]] = []
            for c, salt, role, cid, s in zip(*(b.column(i).to_pylist() for i in range(4)), sets):
                if role == 0:
                    at, centre = (c, salt), s
                elif at == (c, salt):
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(s) - both):
                        out.append((c, cid))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].cast("string").alias("text"))


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored ``wanted`` rows (_id, _th and others) with the texts of their documents."""
    side = small_side(wanted)
    return _keyed(docs).join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).drop("doc_id", "th", "_id", "_th")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a: centre, b) of stored ``pairs`` whose full sets are similar enough, stored."""
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        sizes = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("int").alias("salts"))
        sizes = materialise(sizes, "neardup-centres")
        centres = sizes.select(F.col("_a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("_a").alias("_c"))
        others = pairs.join(sizes, F.col("a") == F.col("_a")).select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("_c"))
        roles = centres.unionByName(others).join(classes.select("cid", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), F.col("_c") == F.col("cid"))
        roles = materialise(roles.select("centre", "salt", "role", "cid", "_id", "_th"), "neardup-roles")
        seen = _with_text(docs, roles).select("centre", "salt", "role", "cid", "text")
        seen = seen.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
        kept.append(materialise(seen.mapInArrow(_compare(size, percent), "a bigint, b bigint").distinct(), "neardup-links"))
    return kept[0]


def _shingles(size: int):
    """(cid, tok) of every shingle of (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            cid, sets = b.column(0).to_numpy(), shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), hashes, size)
            ends = np.cumsum([len(s) for s in sets])
            k = 0
            while k < len(sets):
                m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH_SHINGLES)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[k:m], [len(s) for s in sets[k:m]])), pa.array(np.concatenate(sets[k:m]).view(np.int64))], ["cid", "tok"])
                k = m

    return run


def meetings(crowd: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(v, root): clusters of the classes of stored ``crowd`` (cid, root, n, _id, _th), stored. Pairs that are similar enough and have different roots are in one cluster.

    Let t be the similarity and x, y two sets, ordered alike by rareness. If they
    are similar enough they share t / (1 + t) (|x| + |y|) shingles, so at least so
    many follow their first common one (itself included) in both. A shingle at
    some place of a set of n thus bounds the size of a partner that is first met
    there from above (``hi``); the smaller set must meet its partner at a place
    where its own size passes the bound. Shingles that only one class has meet no
    one but take the first places. The classes that have a shingle early enough
    are tied to one of those that may be the smaller one there, a row a class.
    """
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        texts = _with_text(docs, crowd.select("cid", "_id", "_th")).select("cid", "text")
        tokens = materialise(texts.mapInArrow(_shingles(size), "cid bigint, tok bigint"), "neardup-shingles")
        shared = tokens.groupBy(F.col("tok").alias("_t")).agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        ranked = tokens.join(shared, F.col("tok") == F.col("_t")).groupBy(F.col("cid").alias("_c")).agg(F.sort_array(F.collect_set(F.struct("df", "tok"))).alias("s"))
        ranked = ranked.join(crowd.select("cid", "root", "n"), F.col("_c") == F.col("cid"))
        # places count from 0; the last one that can meet anyone leaves t n shingles
        last = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long")
        own = F.col("n") - F.size("s")
        early = ranked.where(last >= own).select("cid", "root", "n", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), (last - own + 1).cast("int"))).alias("i", "x"))
        most = F.floor((F.col("n") - F.col("own") - F.col("i")) * (100 + percent) / percent + 1e-6).cast("long")  # of both sizes together
        early = materialise(early.select("cid", "root", F.col("x.tok").alias("tok"), (most >= 2 * F.col("n")).alias("smaller")), "neardup-early")
        hubs = early.groupBy(F.col("tok").alias("_t")).agg(F.min(F.when(F.col("smaller"), F.col("cid"))).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("up"))
        tied = early.join(hubs.where("hub is not null and lo <> up"), F.col("tok") == F.col("_t")).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
        kept.append(components(tied, "neardup-meetings"))
    return kept[0]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, as a table for each of its values."""
    parts: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if parts and parts[0].column(0)[0].as_py() != k[lo]:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _agreeing(least_agreement: float, percent: int):
    """Of blocks (key, inner, block, cid, n, root, sig): each class with the later ones that it must be compared with, those that agree most first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            key, inner = g.column(0)[0].as_py(), g.column(1)[0].as_py()
            block, cid, n, root = (g.column(i).to_numpy() for i in (2, 3, 4, 5))
            sig = np.frombuffer(b"".join(g.column(6).to_pylist()), np.uint16).reshape(-1, _K)
            others: dict[int, list[int]] = {}
            for i in range(len(cid)):
                apart = root[i + 1:] != root[i]
                if not inner:
                    apart &= block[i + 1:] != block[i]
                j = np.flatnonzero(apart) + i + 1
                j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
                agree = (sig[j] == sig[i]).mean(1)
                j = j[np.argsort(-agree, kind="stable")[: int((agree >= least_agreement).sum())]]
                if len(j):
                    others.setdefault(i, []).extend(j.tolist())
                    for x in j.tolist():
                        others.setdefault(x, [])
            at = np.array(list(others), np.int64)
            ids = cid.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(at), pa.int64()), pa.array(cid[at]), pa.array(root[at]), pa.array([[ids[x] for x in xs] for xs in others.values()], pa.list_(pa.int64()))], ["key", "cid", "root", "others"])

    return run


def _compare_blocks(size: int, percent: int):
    """Links (a, b) that connect what is similar enough in blocks (key, cid, root, others, text); classes of one root are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for g in _groups(batches):
            cids, roots, others = (g.column(k).to_pylist() for k in (1, 2, 3))
            sets = dict(zip(cids, shingle_sets(g.column(4).cast(pa.binary()).to_pylist(), hashes, size)))
            root = dict(zip(cids, roots))
            top = {r: r for r in roots}

            def find(x: int) -> int:
                while top[x] != x:  # noqa: B023
                    top[x] = x = top[top[x]]  # noqa: B023
                return x

            out = []
            for c, xs in zip(cids, others):
                for x in xs:
                    if find(root[c]) != find(root[x]):
                        a, b = sets[c], sets[x]
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if 100 * both >= percent * (len(a) + len(b) - both):
                            top[find(root[c])] = find(root[x])
                            out.append((c, x))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def crowd_links(crowd: DataFrame, leaders: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all classes of stored ``crowd`` that are similar enough and have different roots, stored."""
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        cluster = meetings(crowd, docs, size, percent).select(F.col("v").alias("_v"), F.col("root").alias("cluster"))
        members = materialise(crowd.join(cluster, F.col("cid") == F.col("_v")).drop("_v"), "neardup-members")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
        mixed = members.groupBy(F.col("cluster").alias("_k")).agg(F.min("root").alias("lo"), F.max("root").alias("up"), blocks.alias("blocks")).where("lo <> up").select("_k", "blocks")
        placed = members.join(mixed, F.col("cluster") == F.col("_k")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        placed = placed.join(leaders.select(F.col("cid").alias("_c"), "sig"), F.col("cid") == F.col("_c"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other"))
        placed = placed.select(key.alias("key"), (F.col("block") == F.col("other")).alias("inner"), "block", "cid", "n", "root", "sig").repartition("key").sortWithinPartitions("key", "cid")
        found = materialise(placed.mapInArrow(_agreeing(_least_agreement(), percent), "key bigint, cid bigint, root bigint, others array<bigint>"), "neardup-blocks")
        found = materialise(found.join(crowd.select(F.col("cid").alias("_c"), "_id", "_th"), F.col("cid") == F.col("_c")).drop("_c"), "neardup-blocks")
        seen = _with_text(docs, found).select("key", "cid", "root", "others", "text").repartition("key").sortWithinPartitions("key", "cid")
        kept.append(materialise(seen.mapInArrow(_compare_blocks(size, percent), "a bigint, b bigint").distinct(), "neardup-links"))
    return kept[0]


def _least_agreement() -> float:
    """Four standard errors below the similarity asked for."""
    return (PERCENT - 4 * (PERCENT * (100 - PERCENT) / _K) ** 0.5) / 100


def _rated(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough, with their agreement, stored."""
    sig = leaders.select(F.col("cid").alias("_c"), "sig")
    rated = pairs.join(sig, F.col("a") == F.col("_c")).select("a", "b", F.col("sig").alias("x"))
    rated = rated.join(sig, F.col("b") == F.col("_c")).select("a", "b", "x", F.col("sig").alias("y"))
    return materialise(rated.mapInArrow(_agreement, "a bigint, b bigint, agree double").where(F.col("agree") >= _least_agreement()), "neardup-candidates")


def _stars(rated: DataFrame, leaders: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Confirmed links (a: centre, b) of candidate clusters to their centres.

    The centre is the class that agrees most with its candidates: in a group of
    copies of one text that is the text itself, even if no two copies are similar
    enough. This only saves work: what is left apart is compared by the caller.
    """
    both = rated.select(F.col("a").alias("v"), "agree").unionAll(rated.select("b", "agree"))
    central = both.groupBy(F.col("v").alias("_c")).agg(F.avg("agree").alias("mean"))
    cluster = components(rated.select("a", "b"), "neardup-clusters")
    rank = F.struct(F.col("mean").alias("m"), (-F.col("v")).alias("v"))
    centre = materialise(cluster.join(central, F.col("v") == F.col("_c")).groupBy(F.col("root").alias("_r")).agg(F.max_by("v", rank).alias("centre")), "neardup-centre")
    placed = cluster.join(centre, F.col("root") == F.col("_r")).where("v <> centre").select(F.col("centre").alias("a"), F.col("v").alias("b"))
    return confirmed(materialise(placed, "neardup-placed"), leaders, docs, size)


def _crowd(runs: DataFrame, trees: DataFrame, root: DataFrame, leaders: DataFrame) -> DataFrame:
    """(cid, root, n, _id, _th) of the classes in stored prefix runs (tree, prefix) that ``root`` (v, root) doesn't connect, stored."""
    keys = small_side(runs.select(F.col("tree").alias("_t"), F.col("prefix").alias("_p")))
    members = trees.withColumn("prefix", F.substring("label", 1, 2 * LEAST_DEPTH)).join(keys, (F.col("tree") == F.col("_t")) & (F.col("prefix") == F.col("_p"))).select("tree", "prefix", "cid")
    members = materialise(members.join(root, F.col("cid") == F.col("v"), "left").select("tree", "prefix", "cid", F.coalesce("root", "cid").alias("root")), "neardup-runs")
    mixed = members.groupBy(F.col("tree").alias("_t"), F.col("prefix").alias("_p")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = small_side(materialise(mixed.drop("lo", "hi"), "neardup-mixed"))
    crowd = members.join(mixed, (F.col("tree") == F.col("_t")) & (F.col("prefix") == F.col("_p"))).groupBy(F.col("cid").alias("_c")).agg(F.first("root").alias("root"))
    crowd = crowd.join(leaders.select("cid", "n", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), F.col("_c") == F.col("cid"))
    return materialise(crowd.select("cid", "root", "n", "_id", "_th"), "neardup-crowd")


def _links(leaders: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links (a, b) that connect what is similar enough, from stored classes (cid, doc_id, th, n, sig)."""
    # the forest; labels are big-endian so that bytes sort as values do
    trees = leaders.select("cid", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("label")))).alias("x"))
    trees = trees.select("x.tree", "x.label", "cid", "n")
    forest = trees.repartitionByRange("tree", "label", "cid").sortWithinPartitions("tree", "label", "cid")
    forest = materialise(forest.mapInArrow(_neighbours(DEPTH, LEAST_DEPTH, NEIGHBOURS), "a bigint, b bigint, tree int, prefix binary").distinct(), "neardup-neighbours")
    runs = materialise(forest.where("a is null").select("tree", "prefix").distinct(), "neardup-long")
    rated = _rated(forest.where("a is not null").select("a", "b"), leaders)
    near = _stars(rated, leaders, docs, size)
    root = components(near, "neardup-linked")
    crowd = _crowd(runs, trees, root, leaders)
    crowded = crowd_links(crowd, leaders, docs, size)
    # candidates whose ends the stars leave apart, but for those with both ends in the crowd
    home = root.select(F.col("v").alias("_v"), F.col("root").alias("_home"))
    member = crowd.select(F.col("cid").alias("_m"), F.lit(True).alias("_in"))
    apart = rated.select("a", "b")
    for end in ("a", "b"):
        apart = apart.join(home, F.col(end) == F.col("_v"), "left").join(member, F.col(end) == F.col("_m"), "left")
        apart = apart.withColumns({f"h{end}": F.coalesce("_home", end), f"in_{end}": F.coalesce("_in", F.lit(False))}).drop("_v", "_home", "_m", "_in")
    apart = apart.where("ha <> hb and not (in_a and in_b)").select("a", "b")
    rest = confirmed(materialise(apart, "neardup-apart"), leaders, docs, size)
    return near.unionByName(rest).unionByName(crowded)


def link(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row: rid, doc_id, th, n_shingles, component_id, and ``first``: whether the row stands for its component."""
    arrow_batches(docs.sparkSession)
    kept: list[DataFrame] = []
    with scope(docs.sparkSession, kept):
        src = spread(_keyed(docs)).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "th", "text")
        rows = materialise(src.mapInArrow(_summarise(size), _ROW), "neardup-rows")
        leader = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid"))
        classes = rows.where("n > 0").groupBy("s1", "s2").agg(leader.alias("m"), F.count(F.lit(1)).alias("rows"))
        classes = materialise(classes.select("s1", "s2", F.col("m.rid").alias("cid"), "m", "rows"), "neardup-classes")
        leaders = rows.join(classes.select("cid"), F.col("rid") == F.col("cid")).select("cid", "doc_id", "th", "n", "sig")
        leaders = materialise(leaders, "neardup-leaders")
        root = components(_links(leaders, docs, size), "neardup-components")
        # a component's first document; classes that stand alone with one row keep their own
        placed = classes.join(root, F.col("cid") == F.col("v"), "left").select("s1", "s2", F.coalesce("root", "cid").alias("root"), "m", "rows")
        firsts = materialise(placed.groupBy("root").agg(F.min("m").alias("first"), F.sum("rows").alias("members")).where("members > 1").select(F.col("root").alias("_root"), "first"), "neardup-firsts")
        groups = materialise(placed.join(firsts, F.col("root") == F.col("_root")).select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("first.doc_id").alias("_id"), F.col("first.rid").alias("_rid")), "neardup-groups")
        kept += [rows, groups]
        side = small_side(groups)
    out = rows.select("rid", "doc_id", "th", "n", "s1", "s2").join(side, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") > 0), "left")
    single = F.col("_rid").isNull()
    return out.select(
        "rid", "doc_id", "th", F.col("n").alias("n_shingles"), F.when(single, F.col("doc_id")).otherwise(F.col("_id")).alias("component_id"),
        F.coalesce(F.col("_rid") == F.col("rid"), F.lit(True)).alias("first"))


def keep_first(docs: DataFrame, size: int = STAGE_SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, and all rows without words."""
    state = materialise(link(docs, size).groupBy("doc_id", "th").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")), "neardup-state")
    key = lambda side: docs["doc_id"].eqNullSafe(side["_id"]) & (F.xxhash64(docs["text"]) == side["_th"])
    some = lambda condition: materialise(state.where(condition).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "neardup-keys")
    drop, again = some("not first"), some("first and rows > 1 and n > 0")
    if not again.head(1):
        return docs.join(drop := small_side(drop), key(drop), "left_anti")
    both = small_side(materialise(drop.unionByName(again), "neardup-keys"))
    again = small_side(again)
    repeated = docs.join(again, key(again), "left_semi")
    packed = repeated.select(F.struct(*[docs[c] for c in docs.columns]).alias("_d"), docs["doc_id"].alias("_i"), F.xxhash64(docs["text"]).alias("_h"))
    return docs.join(both, key(both), "left_anti").unionByName(packed.dropDuplicates(["_i", "_h"]).select("_d.*"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
