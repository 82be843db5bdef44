from __future__ import annotations

import numpy as np
import pytest

from cutline.llm import forest
from cutline.llm.forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, code string, bucket string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", "b", "v") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    good = {}
    dims = [len(v) for _, v in rows if v]
    common = max(set(dims), key=dims.count) if dims else 0
    for i, v in rows:
        if i is not None and v and len(v) == common and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    return {q: sorted(((-float(good[q] @ x), i) for i, x in good.items() if i != q))[:k] for q in good if q % 20 == 0}


def clustered(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[rng.integers(12)] + rng.normal(0, 0.3, dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("chunk", [1 << 16, 300])
def test_recall_and_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(forest, "CHUNK", chunk)
    monkeypatch.setattr(forest, "QUERIES", 16)
    rows = clustered(1500)
    got, want = {}, brute(rows)
    for r in nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert got.keys() == want.keys()
    met = 0
    for q, hits in got.items():
        hits.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in hits] == list(range(1, 21))
        assert [(r["score"], r["vec_id"]) for r in hits] == sorted(((r["score"], r["vec_id"]) for r in hits), key=lambda x: (-x[0], x[1]))
        score = dict((i, -s) for s, i in want[q])
        met += sum(r["vec_id"] in score for r in hits)
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in hits if r["vec_id"] in score)
    assert met >= 0.9 * 20 * len(want)


def test_climb_from_a_base_prefix_and_the_way_out_of_it(spark, monkeypatch):
    rows = clustered(800, seed=2)
    monkeypatch.setattr(forest, "enough_candidates", lambda *a: (60, 2))
    got, want = {}, brute(rows)
    for r in nearest(table(spark, rows)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(v) == 20 for v in got.values()) and got.keys() == want.keys()
    monkeypatch.setattr(forest, "enough_candidates", lambda *a: (10**6, 3))  # nothing is enough: all rows are searched
    for r in nearest(table(spark, rows)).collect():
        assert r["vec_id"] in {i for _, i in want[r["query_id"]]}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 0.5]
    rows = [(0, same), (1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 1]), (5, [nan, 1, 1]), (6, [inf, 1, 1]), (None, [1, 1, 1]), (7, [1, 2]), (8, same), (9, same), (20, [-1, 0, 0]), (8, same), (40, None), (10, [1, 1, 1])]
    got = [tuple(r) for r in nearest(table(spark, rows)).orderBy("query_id", "rank").collect()]
    want = [(q, n, i, -s) for q, hits in sorted(brute(rows).items()) for n, (s, i) in enumerate(hits, 1)]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert nearest(table(spark, [])).count() == 0
    assert nearest(table(spark, [(0, same)])).count() == 0
    assert nearest(table(spark, [(1, same), (2, same)])).count() == 0
