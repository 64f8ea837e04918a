"""The pipeline's stages on odd rows, and its end against plain versions of each stage."""

import collections
from pathlib import Path

import pytest

import corpus_pipeline
from planloom.llm import decontaminate, mixing, quality
from planloom.llm.common import materialize
from test_whole_job import plain_kept

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no sample tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        sets.append(materialize(stage(spark, sets[-1], DATA), "stage"))
        assert sets[-1].columns == COLUMNS
    rows = [collections.Counter(map(tuple, s.collect())) for s in sets]
    ids = [{r[0] for r in s} for s in rows]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert ids[1] == {r.doc_id for r in judged if r.kept}
    assert sorted(ids[2]) == plain_kept([(r.doc_id, r.text) for r in sets[1].collect()])
    bad = {r.doc_id for r in decontaminate.contamination(sets[2], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect() if r.contaminated}
    assert bad and ids[3] == ids[2] - bad
    copies = {r.doc_id: r.copies for r in mixing.plan(sets[3], max_passes=corpus_pipeline.MAX_PASSES).collect()}
    assert {r[0]: n for r, n in rows[4].items()} == copies and ids[4] == ids[3]
    assert all(rows[k].keys() <= rows[k - 1].keys() for k in range(1, 5))  # whole rows, unchanged
    final = corpus_pipeline.STAGES[-1][1](spark, sets[4], DATA).collect()
    assert collections.Counter(r.doc_id for r in final) == collections.Counter(copies)
    at = 0
    for r in sorted(final, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    run = corpus_pipeline.run(spark, DATA).collect()
    assert collections.Counter(map(tuple, run)) == collections.Counter(map(tuple, final))


def test_stages_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    odd = [(1, None, None, None, None), (2, "", "", "", 0), (3, long, "en", "a", 1), (4, long, "en", "b", 1), (None, "no id", None, "b", 2), (5, "x y z", "en", "a", 3), (5, "x y z", "en", "a", 3)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DATA).count() <= 2 * len(rows), name
