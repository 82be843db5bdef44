from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cutline.operators import features as O
from cutline.operators import form as M

SCHEMA = (
    "match_id int, kickoff_at timestamp, home_team_id string, away_team_id string, home_goals_90 int, away_goals_90 int, home_advances boolean"
)


@pytest.fixture
def history(table):
    return M.team_rows(table([
        (1, "2020-01-01", "a", "b", 2, 0, True), (2, "2020-02-01", "c", "a", 1, 1, True), (3, "2020-03-01", "a", "c", None, None, True),
    ], SCHEMA))


def cut(table, *pairs):
    return table(list(pairs), "team_id string, cutoff_time timestamp")


def test_decayed_form_matches_its_definition(history, table):
    r = M.decayed_form(history, cut(table, ("a", "2020-02-11"))).first()
    w1, w2 = 0.5 ** (41 / 180), 0.5 ** (10 / 180)
    assert r["weighted_points"] == pytest.approx((3 * w1 + 1 * w2) / (w1 + w2))
    assert r["weighted_goal_difference"] == pytest.approx(2 * w1 / (w1 + w2))
    assert r["rest_days"] == 10


def test_form_is_strict_and_defaults_apply(history, table):
    r = {x["team_id"]: x for x in M.decayed_form(history, cut(table, ("b", "2020-01-01"), ("zz", "2020-05-01"))).collect()}
    assert all((x["weighted_points"], x["weighted_goal_difference"], x["rest_days"]) == (0.0, 0.0, 7) for x in r.values())


@pytest.mark.parametrize("half_life", [0.02, 0.5, 3, 29])
def test_any_half_life(history, table, half_life):
    r = M.decayed_form(history, cut(table, ("a", "2020-02-11"), ("a", "2030-01-01"), ("b", "2020-01-01")), half_life_days=half_life).collect()
    r = {(x["team_id"], x["cutoff_time"].year): x for x in r}
    w1 = 0.5 ** (31 / half_life)  # the older of two matches, 31 days before the newer
    assert r["a", 2020]["weighted_points"] == pytest.approx((3 * w1 + 1) / (w1 + 1))
    assert r["a", 2020]["weighted_goal_difference"] == pytest.approx(2 * w1 / (w1 + 1))
    assert r["a", 2020]["rest_days"] == 10 and r["b", 2020]["rest_days"] == 7 and r["a", 2030]["rest_days"] > 3000


def test_last_n_returns_exactly_the_newest(history, table):
    got = M.last_n(history, cut(table, ("a", "2020-03-01")), 5).select("match_id", "recency").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1)]
    got = M.last_n(history, cut(table, ("a", "2021-03-01")), 2).select("match_id", "recency").collect()
    assert sorted(map(tuple, got)) == [(2, 2), (3, 1)]


def test_opponent_weighted_form(history, table):
    asks = table([("a", "2020-02-11", "c", 1800.0)], "team_id string, cutoff_time timestamp, opponent_id string, opponent_rating double")
    got = M.opponent_weighted_form(history, asks).first()["form"]
    w1, w2 = 0.5 ** (41 / 365) * 1500, 0.5 ** (10 / 365) * 1800
    assert got == pytest.approx((3 * w1 + 1 * w2) / (w1 + w2))


def test_v1_defaults_and_width(table):
    none = table([], SCHEMA)
    from cutline.operators.elo import elo_ratings

    empty = elo_ratings(none.withColumn("neutral_venue", F.lit(True)))
    m = table([(9, "2020-01-10T12:00:00", "a", "b", "final")], "match_id int, kickoff_at timestamp, home_team_id string, away_team_id string, stage_canonical string")
    r = O.v1_feature_table(m, none, empty).first().asDict()
    assert len(O.V1_FEATURES) == 15 and set(O.V1_FEATURES) <= r.keys()
    assert (r["rest_days_home"], r["rest_days_away"], r["elo_home_win_prob"], r["is_final"], r["form_home"]) == (7.0, 7.0, 0.5, 1, 0.0)


def test_v1_sign_flips_when_sides_swap(table):
    from cutline.operators.elo import elo_ratings

    res = table([(1, "2020-01-01", "a", "b", 2, 0, True), (2, "2020-02-01", "c", "a", 1, 1, True), (3, "2020-02-05", "b", "c", 0, 3, False)], SCHEMA)
    h = elo_ratings(res.withColumn("neutral_venue", F.lit(True)))
    schema = "match_id int, kickoff_at timestamp, home_team_id string, away_team_id string, stage_canonical string"
    ab = O.v1_feature_table(table([(9, "2020-03-10", "a", "b", "final")], schema), res, h).first()
    ba = O.v1_feature_table(table([(9, "2020-03-10", "b", "a", "final")], schema), res, h).first()
    for c in ("elo_difference", "form_difference", "goal_diff_difference", "rest_days_difference"):
        assert ab[c] == pytest.approx(-ba[c], abs=1e-12)
    assert ab["elo_difference"] != 0 and math.isclose(ab["elo_home_win_prob"] + ba["elo_home_win_prob"], 1)


def test_v1_fetches_one_row_a_side_from_chunks_of_ranks(spark, monkeypatch):
    """The last rows of a chunk reach into the next; nothing is repeated, and each rank sees exactly its n newest rows."""
    monkeypatch.setattr(O, "CHUNK", 8)
    rows = spark.range(60).select(F.lit("a").alias("team_id"), F.timestamp_seconds(F.col("id") * 86400).alias("kickoff_at"), (F.col("id") + 1).alias("rank"))
    got = {r["rank"]: r["past"] for r in O.last_ranks(rows, "rank", 5, {"past": F.collect_list("rank")}).collect()}
    assert got == {k: list(range(max(1, k - 4), k + 1)) for k in range(1, 61)}
