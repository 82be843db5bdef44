from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import mixing
from cutline.llm.mixing import DOMAINS, fit_rates, mixture, remixed
from tests.llm.conftest import LONG

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q, t = int(rng.random() < 0.8), int(rng.random() < 0.2)
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(10, 120))]
        words += ["nastyword", "foulword"] * t * 3
        rows.append((i, " ".join(words) if q else "*** ".join(words), q, t))
    return rows


def members(spark, p, tokens):
    return spark.createDataFrame([(int(w), [float(x) for x in row]) for row, w in zip(p, tokens, strict=True)], "tokens long, p array<double>")


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_rates_are_the_bounded_least_squares(spark, floor):
    rng = np.random.default_rng(3)
    p, w = rng.dirichlet([0.3] * 4, 300), rng.integers(1, 900, 300)
    targets = {"clean": 0.3, "poor": 0.3, "poor_toxic": 0.1, "clean_toxic": 0.3}
    fit = fit_rates(members(spark, p, w), targets, floor=floor, keep_total=floor == 0)
    rate = np.array([r[0] for r in members(spark, p, w).select(fit.rate(F.col("p"))).collect()])
    assert rate.min() >= floor and rate.max() <= mixing.MOST_REPEATS
    reached = (rate * w) @ p
    assert reached == pytest.approx([fit.reached[d] for d in DOMAINS], rel=1e-6)
    total = sum(fit.wanted.values())
    # At the least-squares fit the gradient is zero inside the bounds and points outwards at them.
    gradient = p @ np.linalg.inv((p * w[:, None]).T @ p) @ (reached - [fit.wanted[d] for d in DOMAINS])
    low, high = rate <= floor + 1e-9, rate >= mixing.MOST_REPEATS - 1e-9
    assert np.abs(gradient[~low & ~high]).max() < 2e-3 and (gradient[low] > -2e-3).all() and (gradient[high] < 2e-3).all()
    if not floor:
        assert np.abs(reached / total - [targets[d] for d in DOMAINS]).max() < 2e-4


def test_targets_out_of_reach(spark):
    p = np.tile([0.0, 0.0, 1.0, 0.0], (20, 1))
    fit = fit_rates(members(spark, p, np.full(20, 10)), {"poor": 1.0})
    assert fit.reached["poor"] == 0
    with pytest.raises(ValueError):
        fit_rates(members(spark, p, np.full(20, 10)), {"other": 1.0})
    assert fit_rates(members(spark, p[:0], []), {"poor": 1.0}).steps == []


def test_mixture(spark, documents):
    rows = corpus(500)
    extra = [(900, None), (901, ""), (902, LONG[:3000]), (None, "no id"), rows[0][:2]]
    docs = documents([(i, t) for i, t, *_ in rows] + extra, ("p", "rate", "tokens", "domain"))
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows[:300]] + [(None, 1, 1), (3, None, 1), (4, 9, 0), (99999, 1, 1)], LABELS)
    got = mixture(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: 2 * q + t for i, _, q, t in rows}
    held = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 500]
    assert np.mean([DOMAINS[truth[r["doc_id"]]] == r["domain"] for r in held]) > 0.95
    p = np.array([[r[f"p_{d}"] for d in DOMAINS] for r in got])
    assert p.sum(1) == pytest.approx(np.ones(len(got)))
    w, rate = np.array([r["tokens"] for r in got]), np.array([r["rate"] for r in got])
    share = (rate * w) @ p / w.sum()
    assert np.abs(share - [mixing.TARGETS[d] for d in DOMAINS]).max() < 2e-3
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in got)
    assert mixture(documents([(1, LONG), (2, "a")]), labels).where("doc_id = 1").first()["tokens"] == len(LONG.split())
    assert mixture(documents([]), labels).count() == 0
    flat = mixture(docs, spark.createDataFrame([], LABELS)).first()
    assert flat["p_clean"] == 0.25


def test_remixed_keeps_every_document(spark, documents):
    rows = corpus(200, seed=2)
    docs = documents([(i, t) for i, t, *_ in rows] + [(None, "no id"), (300, None)], ("_p", "_copies", "_copy"))
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], LABELS)
    out = remixed(docs, labels, {"clean": 0.7, "clean_toxic": 0.3})
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    assert set(got) == {i for i, *_ in rows} | {None, 300} and len(got) > len(set(got))


def test_a_rare_domain_is_repeated_as_often_as_its_target_needs(spark):
    p = np.repeat(np.eye(4)[[2, 3]], [95, 5], 0)
    rows, targets = members(spark, p, np.full(100, 10)), {"clean": 0.5, "clean_toxic": 0.5}
    fit = fit_rates(rows, targets)
    assert fit.reached["clean_toxic"] == pytest.approx(500, abs=1) and fit.reached["clean"] == pytest.approx(500, abs=1)
    held = fit_rates(rows, targets, ceil=4.0)
    assert held.wanted["clean_toxic"] == 500 and held.reached["clean_toxic"] == pytest.approx(200)


def test_a_fit_that_has_not_settled_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    rng = np.random.default_rng(3)
    with pytest.raises(RuntimeError, match="did not settle"):
        fit_rates(members(spark, rng.dirichlet([0.3] * 4, 300), rng.integers(1, 900, 300)), {"clean": 0.7, "poor": 0.1, "poor_toxic": 0.1, "clean_toxic": 0.1}, floor=0.5)


def test_totals_are_returned(spark, documents):
    rows = corpus(100)
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], LABELS)
    got = mixture(documents([(i, t) for i, t, *_ in rows]), labels, {"clean": 0.5, "clean_toxic": 0.5}).collect()
    for d in DOMAINS:
        assert sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) == pytest.approx(got[0][f"reached_{d}"], rel=1e-3, abs=1)
    assert got[0]["wanted_clean_toxic"] == pytest.approx(sum(r["tokens"] for r in got) / 2)


def test_the_pipeline_targets_move_the_mix(spark, documents):
    rows = [r for r in corpus(700, seed=4) if r[2] and (not r[3] or r[0] % 2)]
    docs = documents([(i, t) for i, t, *_ in rows])
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], LABELS)
    size, toxic = {i: len(t.split()) for i, t, *_ in rows}, {i for i, _, _, t in rows if t}
    share = lambda ids: sum(size[i] for i in ids if i in toxic) / sum(size[i] for i in ids)
    want = corpus_pipeline.TARGETS["clean_toxic"]
    assert want - share(list(size)) > 0.1
    assert share([r["doc_id"] for r in remixed(docs, labels, corpus_pipeline.TARGETS).collect()]) == pytest.approx(want, abs=0.03)
    got = mixture(docs, labels, corpus_pipeline.TARGETS).collect()
    expected = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) for d in DOMAINS}
    assert expected["clean_toxic"] / sum(expected.values()) == pytest.approx(want, abs=0.01)
