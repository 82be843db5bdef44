from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from cutline.llm import bytenet
from cutline.llm.bytenet import fit, keep_good, quality_scores, scores
from tests.llm.conftest import LONG


def corpus(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 300))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = corpus(400)
    return fit([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy(net):
    rows = corpus(300, seed=4)
    p = scores(net, [t for _, t, _ in rows])
    assert np.mean((p >= 0.7) == np.array([y for *_, y in rows])) > 0.98


def test_whole_text_in_rounds_or_at_once(net, monkeypatch):
    texts = [LONG[:60_000] + "BAD!! " * 3000, "", None, "x", LONG[:3000]]
    once = scores(net, texts)
    monkeypatch.setattr(bytenet, "ROUND", 4096)
    assert np.allclose(scores(net, texts), once, atol=1e-5)
    monkeypatch.undo()
    assert once[0] != pytest.approx(scores(net, [LONG[:60_000]])[0], abs=1e-3)  # the end counts


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    docs = [bytenet._spread(bytes(rng.integers(97, 123, n, np.uint8))) for n in (40, 700, 1500)]
    y = np.array([0, 1, 1], np.float32)
    net = fit(["abc", "DEF"], [0, 1])
    for p in net.parts():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)

    def loss():
        out = 0.0
        for d, t in zip(docs, y, strict=True):
            pooled = bytenet._pooled(net, d)
            v, *_ = bytenet._chunks(pooled, np.zeros(len(d), int))
            z = v.mean(0) @ net.mean + v.max(0) @ net.most + net.shift
            out += np.logaddexp(0, -z if t else z)
        return out / len(y)

    grads, _ = bytenet._gradients(net, docs, y)
    for p, g in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.15, abs=1e-4)


def test_query(spark, documents):
    rows = corpus(200) + [(1000, None, None), (1001, "", None), (1002, LONG, None), (None, "words of no id", None)]
    docs = documents([(i, t) for i, t, _ in rows] + [rows[0][:2]], ("score", "y", "t", "held_out"))
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows if y is not None] + [(None, 1, 1), (5, None, 0), (1001, 7, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels, sample=60).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    truth = {i: y for i, _, y in rows if y is not None}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["held_out"]]) > 0.95
    kept = keep_good(docs, labels, sample=60)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_labels_of_held_out_rows_and_other_columns_are_not_learnt(spark, documents):
    rows = corpus(120)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = [(i, y, 0) for i, _, y in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 0) for i, y, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality_scores(docs, spark.createDataFrame(x, schema), sample=30).collect()) for x in (labels, flipped))
    assert a == b


def test_few_or_no_labels(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    docs = documents([(1, "a"), (2, "b")])
    assert {r["score"] for r in quality_scores(docs, spark.createDataFrame([], schema)).collect()} == {0.5}
    one = {r["score"] for r in quality_scores(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], schema)).collect()}
    assert len(one) == 1 and 0.5 < one.pop() < 1
    assert quality_scores(documents([]), spark.createDataFrame([], schema)).count() == 0
