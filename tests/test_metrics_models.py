from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import folds as O
from cutline.operators import metrics as M
from cutline.operators import models as K


def py(spark, pairs):
    return spark.createDataFrame(pairs, "p double, y int")


def test_half_gives_ln2_and_a_quarter(spark):
    r = M.metric_consistency(py(spark, [(0.5, i % 2) for i in range(60)]), []).first()
    assert r["log_loss_mean"] == pytest.approx(math.log(2)) and r["brier_mean"] == 0.25
    assert r["log_loss_sum"] == pytest.approx(60 * r["log_loss_mean"]) and r["passed"] and r["log_loss_ge_brier"]


def test_strict_consistency_passes_valid_metrics(spark):
    assert M.metric_consistency(py(spark, [(0.9, 1), (0.2, 0)]), [], strict=True).count() == 1


def test_auc(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(20) / 20, rnd.randrange(2)) for _ in range(300)]
    pos = [p for p, y in pairs if y]
    neg = [p for p, y in pairs if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(py(spark, pairs), []).first()["roc_auc"] == pytest.approx(want)
    for bad in ([(0.5, 1), (0.5, 0)], [(0.1, 1), (0.9, 1)]):
        assert math.isnan(M.roc_auc(py(spark, bad), []).first()["roc_auc"])


def test_reliability_has_every_bin(spark):
    t = M.reliability_table(py(spark, [(0.05, 0), (1.0, 1), (0.95, 1)]), [])
    r = {x["bin"]: x for x in t.collect()}
    assert len(r) == 10 and r[9]["count"] == 2 and r[3]["bin_center"] == pytest.approx(0.35) and r[3]["observed_frequency"] is None
    assert M.reliability_points(t).count() == 2
    assert M.ece_of(t, []).first()["ece"] == pytest.approx((0.05 + 2 * 0.025) / 3)
    b = {x["bin"]: x for x in M.reliability_binned(py(spark, [(1.0, 1), (0.1, 0)]), []).collect()}
    assert (b[2]["n"], b[1]["n"], b[1]["observed"]) == (1, 0, None)


def test_summary_skips_missing_folds(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.2, 0), ("b", 0.5, 1)], "fold string, home_advance_probability double, home_advances int")
    rep = M.fold_report(df, market=None, elo=None)
    s = M.summarize_folds(rep).first()
    assert s["n_folds"] == 2 and s["roc_auc"] == 1.0 and s["accuracy_clear_lean"] == 1.0
    assert [r["metric"] for r in M.calibration_view(M.summarize_folds(rep)).collect()] == ["ece"]


def test_constant_baseline_without_training_rows(spark):
    d = py(spark, [(0.1, 1)]).drop("p")
    assert M.constant_baseline(d.limit(0), d).first()["p"] == 0.5


def test_positional_split(spark):
    df = spark.range(8).select(F.timestamp_seconds(F.col("id") * 90000).alias("kickoff_at"), F.col("id").alias("match_id"))
    got = {r["match_id"]: r["part"] for r in O.positional_split(df).collect()}
    assert [got[i] for i in range(8)] == ["train"] * 4 + ["validation"] * 2 + ["test"] * 2
    assert {r["part"] for r in O.positional_split(df.limit(2)).collect()} == {"train", "validation"}


def test_broken_fold_raises(table):
    schema = "fold string, train_start timestamp, train_end timestamp, validation_start timestamp, validation_end timestamp, test_start timestamp, test_end timestamp"
    ok = ("f", "2010-01-01", "2017-12-31", "2018-01-01", "2018-12-31", "2018-12-31", "2022-12-31")
    assert O.validate_folds(table([ok], schema)).count() == 1
    bad = ("g", "2010-01-01", "2018-01-01", "2018-01-01", "2018-12-31", "2019-01-01", "2022-12-31")
    with pytest.raises(ValueError, match="train_end must be < validation_start"):
        O.validate_folds(table([ok, bad], schema))


def test_symmetry(spark):
    a = spark.createDataFrame([(1, 0.7), (2, 0.4)], "m int, p double")
    b = spark.createDataFrame([(1, 0.3), (2, 0.9)], "m int, p double")
    r = O.symmetry_test(a, b, ["m"]).first()
    assert (r["n_pairs"], r["n_fails"], r["passes"]) == (2, 1, False) and r["max_abs_residual"] == pytest.approx(0.3)
    assert O.symmetry_test(a.limit(0), b, ["m"]).first()["passes"] is False


def test_gate_decisions(spark):
    cols = [f"{m}_{w} double" for m in ("log_loss", "brier", "coverage", "calibration", "reliability") for w in ("base", "challenger")]
    win = (0.6, 0.5, 0.25, 0.2, 0.5, 0.5, 0.1, 0.05, None, 0.2)
    lose = (0.6, 0.599, 0.25, 0.2, 0.5, 0.5, 0.1, 0.05, None, 0.2)
    df = spark.createDataFrame([("a", *win), ("b", *win), ("c", *lose)], "fold string, " + ", ".join(cols))
    on = O.gate_decision(df, {"enabled": True}).first()
    assert (on["n_folds_won"], on["becomes_default"]) == (2, True)
    off = O.gate_decision(df).first()
    assert (off["becomes_default"], off["reason"]) == (False, "challenger_disabled_in_config")
    few = O.gate_decision(df, {"enabled": True, "min_folds": 3}).first()
    assert few["reason"] == "only 2 of 3 folds beat the baseline by the required margins (need 3)"


# -- models ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [0, 5, -1]
    z = 0.8 * x[:, 0] - 0.1 * (x[:, 1] - 5)
    y = (rng.random(400) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(i, float(a), None if i % 9 == 0 else float(b), float("nan") if i % 11 == 0 else float(c), None, int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, empty double, y int").cache()


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_exact_medians(frame, limit):
    pdf = frame.toPandas()
    got = K.exact_medians(frame, ["a", "b", "c", "empty"], bracket_rows=limit)
    assert got["empty"] is None
    for c in "abc":
        assert got[c] == pytest.approx(pdf[c].median(), abs=1e-12)


def test_exact_median_of_heavy_ties(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 3.0).otherwise(F.col("id") * 1.0).alias("v"))
    assert K.exact_medians(df, ["v"], bracket_rows=10)["v"] == 3.0


def reference_logistic(x, y, c, w=None):
    """Newton steps on sum(w*loss) + |b|^2/(2c), intercept unpenalised."""
    w = np.ones(len(y)) if w is None else w
    xa = np.column_stack([x, np.ones(len(y))])
    b = np.zeros(xa.shape[1])
    pen = np.r_[np.ones(x.shape[1]), 0.0] / c
    for _ in range(50):
        p = 1 / (1 + np.exp(-xa @ b))
        g = xa.T @ (w * (p - y)) + pen * b
        h = (xa.T * (w * p * (1 - p))) @ xa + np.diag(pen)
        b = b - np.linalg.solve(h, g)
    return b


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_equals_the_penalised_optimum(frame, balanced):
    pdf = frame.toPandas()
    cols = ["a", "b", "c"]
    x = pdf[cols].fillna(pdf[cols].median())
    for c in cols:
        x[f"{c}_isna"] = pdf[c].isna().astype(float)
    x["empty_isna"] = 1.0
    sd = x.std(ddof=0).replace(0, 1.0)
    z = ((x - x.mean()) / sd).to_numpy()
    y = pdf["y"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else None
    want = reference_logistic(z, y, 1.0, w)
    m = K.fit_logistic(frame, [*cols, "empty"], "y", K.LogisticConfig(balanced=balanced))
    assert m.scaling.columns == list(x.columns) and "empty" not in m.scaling.columns
    assert np.allclose(m.model.coefficients.toArray(), want[:-1], atol=1e-4)
    assert m.model.intercept == pytest.approx(want[-1], abs=1e-4)
    p = m.predict(frame.drop("c"), "p")
    assert p.columns == [*frame.drop("c").columns, "p"] and p.filter((F.col("p") <= 0) | (F.col("p") >= 1)).count() == 0
    assert abs(m.importance()[0][1]) >= abs(m.importance()[-1][1])


def test_calibrators_stay_in_bounds_and_are_monotone(spark):
    rnd = random.Random(3)
    pairs = [(p := rnd.randrange(1, 100) / 100, int(rnd.random() < p * p), "x") for _ in range(500)]
    df = spark.createDataFrame(pairs, "stacked_probability double, home_advances int, k string")
    for method in ("isotonic", "platt"):
        got = K.fit_calibrator(df, method=method).predict(df.unionByName(spark.createDataFrame([(0.0, 0, "lo"), (1.0, 1, "hi")], df.schema)))
        r = sorted((x["stacked_probability"], x["calibrated_probability"]) for x in got.collect())
        assert all(1e-6 <= c <= 1 - 1e-6 for _, c in r)
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(r, r[1:]))
    with pytest.raises(ValueError, match="Unknown calibration"):
        K.fit_calibrator(df, method="beta")


def test_stacker(spark):
    df = spark.createDataFrame([(None, 0.6, 0.8, 1), (0.2, 0.3, 0.1, 0)] * 20, "market_probability double, elo_probability double, base_probability double, home_advances int")
    blend = K.fit_stacker(df, method="weighted_blend").predict(df).first()["stacked_probability"]
    assert blend == pytest.approx(0.5 * 0.7 + 0.1 * 0.6 + 0.4 * 0.8)
    assert K.fit_stacker(df).predict(df).filter("stacked_probability is null").count() == 0
    with pytest.raises(ValueError, match="Unknown stacking"):
        K.fit_stacker(df, method="mean")


def test_base_learner_choice():
    assert K.select_base_learner(False, 999, 9)[0] == "logistic"
    assert K.select_base_learner(True, 10, 9)[0] == "logistic"
    assert K.select_base_learner(True, 999, 0) == ("logistic", "no_validation_examples")
    assert K.select_base_learner(True, 999, 9) == ("boosted", "enabled")


def test_boosted_learner_handles_missing_and_categories(frame):
    df = frame.withColumn("cat", F.when(F.col("id") % 2 == 0, "u").otherwise("v"))
    m = K.fit_boosted(df.filter("id < 300"), df.filter("id >= 300"), ["a", "b", "c", "cat"], "y", K.BoostConfig(iterations=3, depth=2), ["cat"])
    assert m.predict(df, "p").filter((F.col("p") < 0) | (F.col("p") > 1)).count() == 0
    assert m.importance()[0][1] > 0
