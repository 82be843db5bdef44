from __future__ import annotations

import os

import pytest

import corpus_pipeline
from cutline.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, SF), f"test-{name}")
        assert after.columns == docs.columns
        ids, kept = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (before, after))
        assert kept <= ids and kept
        if name in ("secrets", "mixing"):
            assert kept == ids
        before = after
    placed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    want = {}
    for r in before.select("doc_id", "text").collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len((r["text"] or "").encode().split())
    got = {r["doc_id"]: r["n"] for r in placed.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert got == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
