from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cutline.operators import elo as E
from cutline.plans.store import materialize
from cutline.sources.sinks import synthetic_matches

SCHEMA = (
    "match_id int, kickoff_at timestamp, home_team_id string, away_team_id string, home_goals_90 int, away_goals_90 int, "
    "neutral_venue boolean, home_advances boolean"
)
DAY = [f"2020-01-{d:02d}T12:00:00" for d in range(1, 20)]


def ratings(df, cfg=None, **kw):
    return {(r["match_key"], r["team_id"]): r["rating"] for r in E.elo_ratings(df, cfg, **kw).collect()}


def test_one_win_on_neutral_ground(table):
    got = ratings(table([(1, DAY[0], "a", "b", 2, 0, True, None)], SCHEMA))
    assert got == {("1", "a"): 1510.0, ("1", "b"): 1490.0}


def test_home_advantage_and_draw(table):
    got = ratings(table([(1, DAY[0], "a", "b", 1, 1, False, None)], SCHEMA))
    expected = 1 / (1 + 10 ** (-60 / 400))
    assert got["1", "a"] == pytest.approx(1500 + 20 * (0.5 - expected))


def test_label_wins_over_score_and_rows_without_either_are_skipped(table):
    got = ratings(table([
        (1, DAY[0], "a", "b", 0, 3, True, True), (2, DAY[1], "c", "d", None, 1, True, None),
    ], SCHEMA))
    assert got == {("1", "a"): 1510.0, ("1", "b"): 1490.0}


def test_equal_time_rule(table):
    df = table([
        (1, DAY[0], "a", "b", 1, 0, True, None), (2, DAY[0], "a", "c", 1, 0, True, None), (3, DAY[1], "a", "d", 1, 0, True, None),
    ], SCHEMA)
    first = ratings(df)
    last = ratings(df, E.EloConfig(equal_time="last"))
    assert first["3", "a"] == pytest.approx(1510 + 20 * (1 - 1 / (1 + 10 ** (-10 / 400))))
    assert last["3", "a"] > first["3", "a"]
    cut = table([("a", DAY[0])], "team_id string, cutoff_time timestamp")
    assert E.rating_asof(E.elo_ratings(df), cut).first()["rating"] == 1510.0


def test_unknown_team_has_the_initial_rating(table):
    df = table([(1, DAY[0], "a", "b", 1, 0, True, None)], SCHEMA)
    cut = table([("zz", DAY[5]), ("a", DAY[0]), ("a", "2019-01-01")], "team_id string, cutoff_time timestamp")
    got = {(r["team_id"], r["cutoff_time"].year): r["rating"] for r in E.rating_asof(E.elo_ratings(df), cut).collect()}
    assert got == {("zz", 2020): 1500.0, ("a", 2020): 1510.0, ("a", 2019): 1500.0}
    strict = E.rating_asof(E.elo_ratings(df), cut, inclusive=False)
    assert {r["rating"] for r in strict.collect()} == {1500.0}


def test_idle_decay_towards_zero_or_a_target(table):
    df = table([(1, DAY[0], "a", "b", 1, 0, True, None)], SCHEMA)
    cut = table([("a", DAY[10])], "team_id string, cutoff_time timestamp")
    import math

    f = math.exp(-0.01 * 10)
    zero = E.EloConfig(time_decay_per_day=0.01)
    mean = E.EloConfig(time_decay_per_day=0.01, decay_target=1500.0)
    assert E.rating_asof(E.elo_ratings(df, zero), cut, zero).first()["rating"] == pytest.approx(1510 * f)
    assert E.rating_asof(E.elo_ratings(df, mean), cut, mean).first()["rating"] == pytest.approx(1500 + 10 * f)


@pytest.fixture(scope="module")
def season(spark):
    df = synthetic_matches(spark.range(400), n_teams=12)
    own = df.filter((F.col("home_team_id") < "team_006") == (F.col("away_team_id") < "team_006"))
    return materialize(own, "season")


@pytest.mark.parametrize("cfg", [E.EloConfig(), E.EloConfig(time_decay_per_day=0.002, mov_multiplier=1, equal_time="last")])
def test_time_slices_equal_one_pass(season, cfg):
    one = ratings(season, cfg)
    many = ratings(season, cfg, max_rows_per_task=15)
    assert one.keys() == many.keys() and len(one) == 2 * season.count()
    assert all(many[k] == pytest.approx(one[k], abs=1e-9) for k in one)


def test_rating_mass_is_conserved(season):
    h = E.rating_steps(E.elo_ratings(season))
    worst = h.groupBy("match_key").agg(F.abs(F.sum("delta")).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-9


def test_future_rows_do_not_change_past_ratings(season):
    cut = F.to_timestamp(F.lit("2013-01-01"))
    early = ratings(season.filter(F.col("kickoff_at") < cut))
    full = ratings(season)
    assert early and all(full[k] == v for k, v in early.items())


def test_probabilities_are_complementary_on_neutral_ground(season):
    h = E.elo_ratings(season)
    m = season.withColumn("cutoff_time", F.col("kickoff_at"))
    swapped = m.withColumnsRenamed({"home_team_id": "_h"}).withColumnsRenamed({"away_team_id": "home_team_id"}).withColumnsRenamed({"_h": "away_team_id"})
    p = "elo_home_advance_probability"
    a = {r["match_id"]: r[p] for r in E.elo_probability(m, h).collect()}
    b = {r["match_id"]: r[p] for r in E.elo_probability(swapped, h).collect()}
    assert all(abs(a[k] + b[k] - 1) < 1e-12 for k in a)


def test_pools_are_found_from_the_meetings(table):
    rows = [(1, DAY[0], "a", "b", 1, 0, True, None), (2, DAY[1], "a", "c", 1, 0, True, None), (3, DAY[2], "x", "y", 1, 0, True, None), (4, DAY[3], "b", "c", 0, 1, True, None)]
    got = {(r["match_key"], r["team_id"]): r["pool"] for r in E.elo_ratings(table(rows, SCHEMA)).collect()}
    assert {p for (_, t), p in got.items() if t in "abc"} == {"a"} and {p for (_, t), p in got.items() if t in "xy"} == {"x"}


def test_a_team_in_two_competitions_has_one_rating(table):
    rows = [(1, DAY[0], "a", "b", 1, 0, True, None), (2, DAY[1], "a", "c", 1, 0, True, None), (3, DAY[2], "a", "z", 0, 1, True, None)]
    competition = ["x", "x", "y"]
    df = table([(*r, c) for r, c in zip(rows, competition, strict=True)], SCHEMA + ", competition_id string")
    cut = table([("a", DAY[5])], "team_id string, cutoff_time timestamp")
    got = E.rating_asof(E.elo_ratings(df), cut).first()["rating"]
    r = 1510.0
    r += 20 * (1 - 1 / (1 + 10 ** ((1500 - r) / 400)))
    r += 20 * (0 - 1 / (1 + 10 ** ((1500 - r) / 400)))
    assert got == pytest.approx(r)


def slices(df, cfg, rows):
    prepared = E.elo_input(df, cfg)
    bounds = E.time_slices(prepared, rows)
    return E.sliced_ratings(prepared, cfg, bounds), len(bounds) + 1


@pytest.mark.parametrize("cfg", [E.EloConfig(), E.EloConfig(time_decay_per_day=0.002, mov_multiplier=1, equal_time="last", decay_target=1500.0)])
def test_slices_settle_in_few_rounds(spark, cfg):
    df = materialize(synthetic_matches(spark.range(1500), n_teams=12), "long-season")
    one = ratings(df, cfg, pools=False)
    (history, rounds), n = slices(df, cfg, 60)
    many = {(r["match_key"], r["team_id"]): r["rating"] for r in history.collect()}
    assert n >= 25 and rounds <= 22
    assert one.keys() == many.keys() and max(abs(many[k] - one[k]) for k in one) < 1e-9


def test_slices_of_teams_that_pause(table):
    """A team that misses slices starts from its own last one; a team that comes late starts from the initial rating."""
    days = [f"2020-{1 + d // 28:02d}-{1 + d % 28:02d}T12:00:00" for d in range(120)]
    rows = [(d, days[d], "ab"[d % 2], "c" if d % 7 else "late" if d > 60 else "d", d % 3, d % 2, d % 5 == 0, None) for d in range(120)]
    rows += [(1000, days[0], "idle", "a", 2, 0, True, None), (1001, days[119], "idle", "b", 0, 1, True, None)]
    df = table(rows, SCHEMA)
    one = ratings(df, pools=False)
    for n in (9, 50):
        got = {(r["match_key"], r["team_id"]): r["rating"] for r in slices(df, E.EloConfig(), n)[0][0].collect()}
        assert max(abs(got[k] - one[k]) for k in one) < 1e-9 and got.keys() == one.keys()


def test_no_task_holds_more_than_a_slice(spark):
    df = materialize(synthetic_matches(spark.range(800), n_teams=6), "one-pool")
    prepared = E.elo_input(df, E.EloConfig())
    bounds = E.time_slices(prepared, 60)
    number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("us")))
    most = prepared.groupBy(number.alias("s")).count().agg(F.max("count")).first()[0]
    assert most <= 60


def test_empty_history(table):
    df = table([(1, DAY[0], "a", "b", None, None, True, None)], SCHEMA)
    assert E.elo_ratings(df).count() == 0


def test_each_slice_is_scanned_by_its_own_task(season):
    """Slices that share a partition, by hash or because small ones are merged, would be scanned one after the other."""
    rows = E.elo_input(season, E.EloConfig())
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("match_key"), F.lit(9)).cast("int"))
    placed = E._scanned(rows, E.EloConfig(), 9).select("slice", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({r["slice"] for r in placed}) == len({r["task"] for r in placed}) == 9
