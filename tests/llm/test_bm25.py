from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from cutline.llm import bm25
from cutline.llm.bm25 import K1, B, build_index, search, terms_of, top_documents
from cutline.llm.common import shared_path
from tests.llm.conftest import LONG


def brute(docs, queries, k):
    counts = [Counter(terms_of(t)) for _, t in docs]
    size = np.array([sum(c.values()) for c in counts], float)
    mean, n = size.sum() / max(1, len(docs)), len(docs)
    out = {}
    for q, text in queries:
        score = np.zeros(n)
        for term, times in sorted(Counter(terms_of(text)).items()):
            tf = np.array([c[term] for c in counts], float)
            df = (tf > 0).sum()
            if df:
                score += times * np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        low = lambda i: -(1 << 63) if i is None else i
        out[q] = sorted(((-s, low(d)) for s, (d, _) in zip(score, docs, strict=True) if s > 0))[:k]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, documents, seed, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 8)
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(120)]
    some = lambda n: " ".join(vocabulary[min(119, int(rng.expovariate(0.06)))] for _ in range(n))
    docs = [(i, some(rng.randrange(0, 60))) for i in range(400)]
    docs += [(500 + i, docs[5][1]) for i in range(15)] + [(7, docs[7][1]), (None, some(20)), (600, None), (601, ""), (602, LONG)]
    queries = [(i, some(rng.randrange(1, 25))) for i in range(25)] + [(50, "t0 T0 t1"), (51, "nothing"), (52, ""), (53, None)]
    index = build_index(documents(docs, ("shard", "bucket", "terms")), shared_path(spark, "bm25"), shard_docs=64)
    got = {}
    for r in search(index, spark.createDataFrame(queries, "query_id long, text string"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], r["score"]))
    for q, want in brute(docs, queries, 10).items():
        have = got.get(q, [])
        assert [h[0] for h in have] == list(range(1, len(want) + 1))
        assert [h[2] for h in have] == pytest.approx([-s for s, _ in want])
        assert [h[1] for h in have] == [d for _, d in sorted((round(s, 9), d) for s, d in want)] or len({round(s, 9) for s, _ in want}) < len(want)


def test_ties_go_to_the_smaller_id(spark, documents):
    docs = documents([(i, "same words here") for i in (9, 4, 30, 2, 7, 2)])
    index = build_index(docs, shared_path(spark, "bm25"), shard_docs=2)
    got = search(index, spark.createDataFrame([(1, "words")], "query_id long, text string"), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [2, 2, 4, 7]


def test_pruning_passes_over_documents():
    n = 5000
    rare, common = np.arange(0, n, 500, dtype=np.int32), np.arange(n, dtype=np.int32)
    lengths = np.full(n, 10, np.int64)
    lists = [bm25._List(rare, np.full(len(rare), 3, np.int32), 8.0, lengths, 10.0), bm25._List(common, np.ones(n, np.int32), 0.01, lengths, 10.0)]
    seen = []
    to = bm25._List.to
    bm25._List.to = lambda self, doc, end: (seen.append(doc), to(self, doc, end))[1]
    try:
        best = bm25.block_max_wand(lists, lengths.tolist(), list(range(n)), 10.0, 5)
    finally:
        bm25._List.to = to
    assert [d for _, _, d in best] == [0, 500, 1000, 1500, 2000] and len(seen) < 2100  # ties of the common word are met until five better ones are


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(0, "a b")], "item_id long, text string")
    assert top_documents(documents([]), items).count() == 0
    assert top_documents(documents([(1, "a")]), items.where("item_id > 5")).count() == 0
