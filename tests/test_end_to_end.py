"""Small season through features, training, prediction, ledger and backtest."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cutline.operators import elo as E
from cutline.operators import features as O
from cutline.operators.ledger import append_predictions, evaluate
from cutline.plans import backtest as B
from cutline.plans import prediction as R
from cutline.plans import training as T
from cutline.plans.store import materialize
from cutline.sources.sinks import synthetic_matches


@pytest.fixture(scope="module")
def world(spark):
    m = synthetic_matches(spark.range(240), n_teams=10).withColumns({"competition_id": F.lit("c"), "stage": F.lit("Final")})
    m = materialize(m, "world")
    quotes = m.select(
        "match_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("bookmaker"), (F.col("kickoff_at") - F.expr("INTERVAL 2 DAY")).alias("captured_at"),
        F.xxhash64("match_id").alias("h"),
    ).select(
        "match_id", "bookmaker", F.lit("home_to_advance").alias("market_type"), F.explode(F.array(F.lit("home"), F.lit("away"))).alias("selection"),
        "captured_at", "h", F.lit(False).alias("is_live"),
    ).withColumn("decimal_odds", 1.5 + F.pmod(F.xxhash64("h", "bookmaker", "selection"), F.lit(20)) / 10)
    avail = m.select(
        "match_id", F.col("home_team_id").alias("team_id"), F.lit("midfielder").alias("role"), F.lit("lineup_confirmed").alias("availability_status"),
        (F.col("kickoff_at") - F.expr("INTERVAL 75 MINUTE")).alias("published_at"),
    )
    return m, quotes, avail


def build(world, hours=24.0, until=None):
    m, quotes, avail = world
    res, q, a = m, quotes, avail
    if until is not None:
        res, q, a = (d.filter(F.col(c) <= until) for d, c in ((m, "kickoff_at"), (quotes, "captured_at"), (avail, "published_at")))
    return O.feature_table(
        O.with_cutoff(m, hours), results=res, ratings=E.elo_ratings(res), quotes=q, availability=a, min_bookmakers=2,
    )


def test_rows_after_the_cutoff_do_not_change_features(world):
    mid = F.to_timestamp(F.lit("2012-06-01"))
    early = F.col("cutoff_time") <= mid
    full = build(world).filter(early)
    cut = build(world, until=mid).filter(early)
    show = lambda d: sorted(map(str, d.select(*O.IDENTITY, *[F.round(c, 9) if t == "double" else c for c, t in d.dtypes if c in O.FEATURES]).collect()))
    assert show(full) == show(cut) and full.count() > 50


def test_lineup_is_hidden_at_24_hours_and_seen_at_75_minutes(world):
    assert build(world, 24.0).agg(F.max("home_lineup_confirmed")).first()[0] == 0.0
    assert build(world, 1.25).agg(F.min("home_lineup_confirmed")).first()[0] == 1.0
    assert build(world, 1.26).agg(F.max("home_lineup_confirmed")).first()[0] == 0.0


def test_sources_are_never_newer_than_the_cutoff(world):
    t = build(world)
    assert t.filter(F.col("source_data_max_timestamp") > F.col("cutoff_time")).count() == 0
    assert t.filter("market_available").count() == t.count()


def test_cutoff_at_kickoff_is_refused(world):
    m = world[0]
    good, bad = O.split_valid_cutoffs(O.with_cutoff(m, 0.0))
    assert good.count() == 0 and bad.first()["reason"] == "cutoff_not_before_kickoff"


@pytest.fixture(scope="module")
def labelled(world):
    m = world[0].select("match_id", F.col("home_advances").cast("int").alias("home_advances"))
    return materialize(build(world).join(m, "match_id"), "labelled")


FEATS = ("elo_difference", "form_points_difference", "rest_days_difference", "market_home_advance_probability")
CONFIG = T.TrainConfig(features=FEATS)


def window(df, a, b):
    return df.filter((F.col("kickoff_at") >= F.lit(a).cast("timestamp")) & (F.col("kickoff_at") < F.lit(b).cast("timestamp")))


@pytest.fixture(scope="module")
def fitted(labelled):
    return T.train(window(labelled, "2010-01-01", "2013-01-01"), window(labelled, "2013-01-01", "2014-01-01"), CONFIG)


def test_train_predict_evaluate(spark, labelled, fitted, tmp_path):
    assert fitted.base_type == "logistic" and fitted.reason == "boosted_disabled_in_config"
    assert set(fitted.metrics) == {"log_loss_stacked", "log_loss_calibrated", "brier_stacked", "brier_calibrated", "roc_auc_calibrated"}
    test = window(labelled, "2014-01-01", "2015-01-01")
    p = R.predict(test, "v1", fitted)
    assert p.count() == test.count() > 10
    assert p.filter(~F.col("calibrated_probability").between(1e-6, 1 - 1e-6)).count() == 0
    stored = append_predictions(p.limit(0), p)
    assert stored.count() == p.count()
    with pytest.raises(Exception, match="already exists"):
        append_predictions(p, p).collect()
    out = test.select("match_id", (F.col("home_advances") == 1).alias("home_advances"))
    assert evaluate(p, out).count() == p.count()
    T.save(fitted, str(tmp_path / "model"), spark)
    back = T.load(str(tmp_path / "model"), spark)
    key = lambda f: sorted((r["match_id"], round(r["calibrated_probability"], 12)) for r in f.score(test).collect())
    assert key(back) == key(fitted)
    again = T.train(window(labelled, "2010-01-01", "2013-01-01"), window(labelled, "2013-01-01", "2014-01-01"), CONFIG)
    assert key(again) == key(fitted)
    runs = T.run_record(spark, fitted, "v1", {"train_start": "2010-01-01"}, CONFIG)
    assert sorted(r["model_type"] for r in runs.collect()) == ["calibration", "logistic", "stacking"]


def test_prediction_without_models(labelled):
    r = R.predict(labelled, "v0").filter("market_probability is not null").first()
    want = 0.5 * r["market_probability"] + 0.1 * r["elo_probability"] + 0.4 * 0.5
    assert r["calibrated_probability"] == pytest.approx(want)
    assert r["explanation"]["data_completeness"]["market_available"]


def test_validation_can_be_split_in_time(labelled):
    cfg = T.TrainConfig(features=FEATS, split_validation=True, calibration="platt")
    f = T.train(window(labelled, "2010-01-01", "2012-06-01"), window(labelled, "2012-06-01", "2014-01-01"), cfg)
    assert f.calibrator.method == "platt"


def test_empty_window_raises(labelled):
    with pytest.raises(ValueError, match="must both contain"):
        T.train(labelled.limit(0), labelled, CONFIG)


def test_walk_forward(labelled, table):
    schema = "fold string, train_start timestamp, train_end timestamp, validation_start timestamp, validation_end timestamp, test_start timestamp, test_end timestamp"
    folds = table([
        ("f1", "2010-01-01", "2012-01-01", "2012-01-02", "2013-01-01", "2013-01-02", "2013-12-31"),
        ("f2", "2010-01-01", "2013-01-01", "2013-01-02", "2014-01-01", "2014-01-02", "2014-12-31"),
    ], schema)
    p = B.walk_forward(labelled, folds, CONFIG)
    rep = B.backtest_report(p)
    got = {r["fold"]: r for r in rep["folds"].collect()}
    assert set(got) == {"f1", "f2"} and sum(r["n_test"] for r in got.values()) == p.count()
    assert rep["summary"].first()["n_folds"] == 2 and rep["reliability"].count() == 20


def test_baseline_report(world):
    from cutline.functions.stages import stage_canonical
    from cutline.operators.folds import positional_split
    from cutline.plans.report import baseline_report

    m = world[0]
    cfg = E.EloConfig(home_advantage=0.0)
    v1 = O.v1_feature_table(m.withColumn("stage_canonical", stage_canonical("stage")), m, E.elo_ratings(m, cfg), config=cfg)
    v1 = materialize(v1.join(m.select("match_id", F.col("home_advances").cast("int").alias("home_advances")), "match_id"), "v1-small")
    rep = baseline_report(v1, positional_split(v1.select("match_id", "kickoff_at")))
    half = rep["metrics"].filter("model = 'reference_half'").first()
    assert half["n"] == 60 and half["log_loss_mean"] == pytest.approx(0.693147, abs=1e-6) and half["brier_mean"] == 0.25
    assert rep["metrics"].count() == 4 and rep["worst"].count() == 30 and rep["symmetry"].first()["n_pairs"] == 60
    assert rep["calibration_status"].first()["insufficient_data"] is False
