"""The pipeline against a brute-force version on a small table, and its stages' promises."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from cellwright.llm import decontaminate, mixing, quality, secrets  # noqa: E402


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "secret scan", "source mix"]


def test_pipeline_against_brute_force(spark, folder):
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    docs = read("documents")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    kept, _ = brute.verdicts([(i, r["text"], r["lang"]) for i, r in rows.items()], [(r.doc_id, r.quality) for r in read("labels").collect()], quality.RULES, quality.MAX_FALSE_REJECTION, quality.DELTA)
    left = [i for i in rows if kept[i]]
    roots, _ = brute.components([(i, rows[i]["text"]) for i in left], size=5)
    left = [i for k, i in enumerate(left) if roots[k] == i]
    found = {r.doc_id for r in decontaminate.find(docs.where(docs.doc_id.isin(left)), read("benchmark")).collect()}
    left = [i for i in left if i not in found]
    forest = secrets.train()
    texts = {}
    for i, spans in zip(left, secrets.find([rows[i]["text"] for i in left], forest)):
        t = rows[i]["text"]
        for s, e, *_ in reversed(spans):
            t = t[:s] + secrets.REDACTED + t[e:]
        texts[i] = t
    sizes = {}
    for i in left:
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + len(brute.words(texts[i]))
    want = brute.targets(sizes, mixing.WEIGHTS, mixing.BUDGET, mixing.MAX_EPOCHS)
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= set(left) and all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in out)
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)
    assert [r.position for r in out] == sorted(r.position for r in out)
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    for s, target in want.items():
        largest = max(len(brute.words(texts[i])) for i in left if rows[i]["source"] == s)
        assert abs(taken.get(s, 0) - target) <= largest / 2 + 1e-6


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for start in (docs.limit(0), docs):
        stage_docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            stage_docs = stage(spark, stage_docs, folder)
            assert stage_docs.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_nulls(spark, folder, name):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0)], spark.read.parquet(f"{folder}/documents.parquet").schema)
    dict(corpus_pipeline.STAGES)[name](spark, docs, folder).collect()
