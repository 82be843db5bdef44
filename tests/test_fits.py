"""Fits of many windows at once, isotonic blocks, out-of-fold stacking."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import models as K
from cutline.operators.isotonic import isotonic_blocks, isotonic_values, pooled
from cutline.operators.newton import Problem, newton
from cutline.plans.backtest import _together, walk_forward
from cutline.plans.store import materialize
from cutline.plans.training import TrainConfig, out_of_fold, time_blocks, train
from tests.test_metrics_models import reference_logistic

COLS = ["elo_difference", "b", "c"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 3)) * [80, 3, 1]
    p = 1 / (1 + np.exp(-(x[:, 0] / 100 + 0.2 * x[:, 1])))
    y = (rng.random(n) < p).astype(int)
    rows = [
        (i, 1_500_000_000 + 86_400 * (i // 3), float(a), None if i % 7 == 0 else float(b), float("nan") if i % 5 == 0 else float(c),
         float(1 / (1 + np.exp(-a / 120))), None if i % 4 == 0 else float(np.clip(q + rng.normal() * 0.05, 0.01, 0.99)), int(t))
        for i, ((a, b, c), q, t) in enumerate(zip(x, p, y, strict=True))
    ]
    df = spark.createDataFrame(rows, "match_id int, s long, elo_difference double, b double, c double, elo_home_advance_probability double, market_probability double, home_advances int")
    df = df.withColumn("kickoff_at", F.timestamp_seconds("s")).withColumn("cutoff_time", F.col("kickoff_at") - F.expr("interval 1 day")).drop("s")
    return materialize(df, "labelled")


def design(pdf, cols):
    x = pdf[cols].fillna(pdf[cols].median())
    for c in cols:
        x[f"{c}_isna"] = pdf[c].isna().astype(float)
    sd = x.std(ddof=0).replace(0, 1.0)
    return ((x - x.mean()) / sd).to_numpy(), list(x.columns)


def test_windows_together_equal_an_independent_solver(labelled):
    members = {"first": F.col("match_id") < 400, "late": F.col("match_id") >= 350, "few": F.col("match_id") % 33 == 0}
    fits = K.fit_logistics(labelled, COLS, members, config=K.LogisticConfig(balanced=True))
    pdf = labelled.toPandas()
    for name, own in (("first", pdf.match_id < 400), ("late", pdf.match_id >= 350), ("few", pdf.match_id % 33 == 0)):
        part = pdf[own]
        z, names = design(part, COLS)
        y = part["home_advances"].to_numpy()
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        want, m = reference_logistic(z, y, 1.0, w), fits[name]
        assert m.scaling.columns == names and m.train_rows == len(part)
        assert np.allclose([*m.model.coefficients, m.model.intercept], want, atol=1e-8)
        assert m.model.gradient <= 1e-10 and m.model.steps <= 12
        p = {r["match_id"]: r["p"] for r in m.predict(labelled.where(members[name]), "p").collect()}
        got = np.array([p[i] for i in part["match_id"]])
        assert np.allclose(got, 1 / (1 + np.exp(-(z @ want[:-1] + want[-1]))), atol=1e-8)


def test_windows_of_one_class_and_of_none(spark):
    df = spark.createDataFrame([(1.0, 1, "a"), (2.0, 1, "a"), (1.0, 0, "b"), (None, 1, "c")], "x double, y int, k string")
    one = lambda k: Problem(F.col("k") == k, [F.col("x")], F.col("y"), F.lit(1.0))
    fits = newton(df, {k: one(k) for k in "abcd"})
    assert (fits["a"].intercept, fits["b"].intercept) == (float("inf"), float("-inf"))
    assert all(list(f.coefficients) == [0.0] for f in fits.values()) and fits["c"].intercept == fits["d"].intercept == 0.0
    assert [r[0] for r in df.select(fits["a"].probability([F.col("x")])).where("k = 'a'").collect()] == [1.0, 1.0]


def test_separable_rows_settle(spark):
    df = spark.createDataFrame([(float(i), int(i > 50)) for i in range(101)], "x double, y int")
    fit = newton(df, {"": Problem(F.lit(True), [(F.col("x") - 50) / 29], F.col("y"), F.lit(1.0), 1e6)})[""]
    assert fit.gradient <= 1e-10 and fit.coefficients[0] > 10


FOLDS = "fold string, train_start timestamp, train_end timestamp, validation_start timestamp, validation_end timestamp, test_start timestamp, test_end timestamp"


def test_backtest_together_equals_fold_after_fold(spark, labelled, table):
    days = [f"2017-{m:02d}-01" for m in range(8, 13)] + [f"2018-{m:02d}-01" for m in range(1, 6)]
    folds = table([("f1", days[0], days[3], "2017-11-02", days[5], days[5], days[7]), ("f2", days[0], days[4], "2017-12-02", days[6], days[6], days[8])], FOLDS)
    cfg = TrainConfig(features=tuple(COLS))
    got = {(r["fold"], r["match_id"]): r for r in walk_forward(labelled, folds, cfg).collect()}
    assert len({f for f, _ in got}) == 2
    for f in folds.collect():
        win = lambda p, f=f: labelled.where(F.col("kickoff_at").between(F.lit(f[f"{p}_start"]), F.lit(f[f"{p}_end"])))
        one = train(win("train"), win("validation"), cfg).score(win("test")).collect()
        assert len(one) == sum(k[0] == f["fold"] for k in got)
        for r in one:
            both = got[f["fold"], r["match_id"]]
            assert both["base_probability"] == pytest.approx(r["base_probability"], abs=1e-7)
            assert both["home_advance_probability"] == pytest.approx(r["calibrated_probability"], abs=1e-6)
    with pytest.raises(ValueError, match="must both contain"):
        _together(labelled.where("match_id < 0"), folds.collect(), cfg)


# -- isotonic --------------------------------------------------------------------------------

def plain(points):
    """Pool adjacent violators over (x, y, weight), a value at a time."""
    by = {}
    for x, y, w in points:
        t, u = by.get(x, (0.0, 0.0))
        by[x] = t + y * w, u + w
    out = []
    for x in sorted(by):
        out.append([x, x, *by[x]])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return [(a, b, t / w) for a, b, t, w in out]


def value(blocks, x):
    if x <= blocks[0][0]:
        return blocks[0][2]
    for (a, b, v), nxt in zip(blocks, [*blocks[1:], None], strict=True):
        if a <= x <= b or nxt is None:
            return v
        if b < x < nxt[0]:
            return v + (nxt[2] - v) * (x - b) / (nxt[0] - b)
    raise AssertionError


CASES = {
    "noise": lambda r: [(r.random(), int(r.random() < 0.5), 1.0) for _ in range(700)],
    "ties": lambda r: [(r.randrange(9) / 8, int(r.random() < 0.4), r.choice([1.0, 2.5])) for _ in range(300)],
    "rising": lambda r: [(i / 500, i / 500, 1.0) for i in range(500)],
    "falling": lambda r: [(i / 500, 1 - i / 500, 1.0) for i in range(500)],
    "steps": lambda r: [(i / 600, (i // 40) * 0.05 + (i % 40 < 3) * 0.6, 1.0) for i in range(600)],
    "one value": lambda r: [(0.5, 1, 1.0), (0.5, 0, 3.0)],
}


@pytest.mark.parametrize("part_rows", [37, 200_000])
def test_blocks_equal_the_plain_algorithm(spark, part_rows):
    rng = random.Random(2)
    cases = {k: f(rng) for k, f in CASES.items()}
    rows = [(k, x, float(y), w) for k, pts in cases.items() for x, y, w in pts] + [("noise", None, 1.0, 1.0), ("noise", 0.3, None, 1.0), (None, 0.25, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double")
    blocks = isotonic_blocks(df, ["k"], "x", "y", "w", part_rows)
    got = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["k"] or "", r["lo"])):
        got.setdefault(r["k"], []).append((r["lo"], r["hi"], r["value"]))
    for k, pts in cases.items():
        want = plain(pts)
        assert [g[:2] for g in got[k]] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got[k]], [w[2] for w in want], atol=1e-12)
    assert got[None] == [(0.25, 0.25, 1.0)]
    if part_rows == 37:
        ask = spark.createDataFrame([(k, x, i) for k in cases for i, x in enumerate([-1.0, 0.0, 0.013, 0.25, 0.5, 0.7777, 1.0, 2.0, None, 0.5])] + [("other", 0.5, 0)], "k string, x double, i int")
        found = isotonic_values(ask, blocks, ["k"], "x", "v", slices=8).collect()
        assert len(found) == 61
        for r in found:
            if r["x"] is None or r["k"] == "other":
                assert r["v"] is None
            else:
                assert r["v"] == pytest.approx(value(plain(cases[r["k"]]), r["x"]), abs=1e-12)


def test_pooling_can_start_anywhere():
    rng = np.random.default_rng(1)
    y = np.sort(rng.random(200)) + rng.normal(size=200) * 0.3
    x, w = np.arange(200.0), rng.integers(1, 5, 200).astype(float)
    whole = pooled(x, x, y * w, w)
    halves = [b for s in (slice(0, 70), slice(70, 150), slice(150, 200)) for b in pooled(x[s], x[s], (y * w)[s], w[s])]
    again = pooled(*(np.array(c) for c in zip(*halves, strict=True)))
    assert [b[:2] for b in again] == [b[:2] for b in whole] and np.allclose([b[2] for b in again], [b[2] for b in whole])


# -- out-of-fold -----------------------------------------------------------------------------

def test_no_label_reaches_its_own_row_or_an_earlier_one(labelled):
    base = {r["match_id"]: r for r in out_of_fold(labelled, COLS, 4).collect()}
    cut = sorted(base)[600]
    flipped = labelled.withColumn("home_advances", F.when(F.col("match_id") >= cut, 1 - F.col("home_advances")).otherwise(F.col("home_advances")))
    other = {r["match_id"]: r for r in out_of_fold(materialize(flipped, "flipped"), COLS, 4).collect()}
    block = base[cut]["block"]
    first = {i: (r["base_probability"], other[i]["base_probability"]) for i, r in base.items() if r["block"] <= block and r["block"] > 0}
    assert len(first) > 300 and all(a == pytest.approx(b, abs=1e-12) for a, b in first.values())
    assert any(abs(r["base_probability"] - other[i]["base_probability"]) > 1e-3 for i, r in base.items() if r["block"] > block)
    for r in base.values():
        assert (r["source"] is None) == (r["block"] == 0) == (r["base_probability"] is None)
        assert r["block"] == 0 or r["trained_until"] <= r["kickoff_at"]


def test_a_block_is_scored_by_the_model_of_what_is_earlier(labelled):
    got = out_of_fold(labelled, COLS, 2)
    cuts = time_blocks(labelled, 3)
    assert len(cuts) == 2
    own = K.fit_logistic(labelled.where(F.col("kickoff_at") < F.lit(cuts[1])), COLS)
    want = {r["match_id"]: r["p"] for r in own.predict(labelled, "p").collect()}
    rows = got.where("block = 2").collect()
    assert rows and all(r["base_probability"] == pytest.approx(want[r["match_id"]], abs=1e-9) for r in rows)


def test_rows_of_one_instant_share_a_block(labelled):
    same = labelled.withColumn("kickoff_at", F.lit("2020-01-01").cast("timestamp"))
    assert time_blocks(same, 4) == [] and time_blocks(same.limit(0), 4) == []
    assert {r["block"] for r in out_of_fold(same, COLS, 3).collect()} == {0}
    few = out_of_fold(labelled, COLS, 5).groupBy("kickoff_at").agg(F.count_distinct("block").alias("n"))
    assert few.agg(F.max("n")).first()[0] == 1


def test_stacker_on_out_of_fold_rows(labelled):
    tr, val = labelled.where("match_id < 600"), labelled.where("match_id between 600 and 750")
    plain_, oof = (train(tr, val, TrainConfig(features=tuple(COLS), oof_splits=n)) for n in (0, 4))
    assert list(plain_.base.model.coefficients) == pytest.approx(list(oof.base.model.coefficients))
    assert list(plain_.stacker.model.coefficients) != list(oof.stacker.model.coefficients)
    scored = oof.score(labelled.where("match_id > 750"))
    assert scored.where("calibrated_probability is null").count() == 0
