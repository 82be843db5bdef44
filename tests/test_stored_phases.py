"""Feature tables are built in stored phases, so that what each of them shuffles does not add up on disk."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from cutline.catalog.bindings import Views
from cutline.operators import lineup, market
from cutline.plans.store import materialize

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if "shuffle_" in str(files.apply(i).getName()) and str(files.apply(i).getName()).endswith(".data")}


def test_a_stored_table_releases_what_the_ones_before_it_shuffled(spark):
    def build(name):
        return materialize(spark.range(50_000).repartition(7, F.col("id") % 5).groupBy((F.col("id") % 1000).alias("k")).count(), name)

    before = shuffled(spark)
    build("first")
    time.sleep(1)
    own = shuffled(spark) - before
    out = build("second")
    until = time.time() + 20
    while shuffled(spark) & own and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) & own and out.count() == 1000


def test_wide_rows_of_the_feature_table_meet_one_match_block(spark):
    from cutline.catalog.features import features

    text = plan(features(Views(spark, SF)))
    assert text.count("Join LeftOuter") <= 4  # two sides, competition, match block


def test_cut_offs_are_not_copied_for_salts(spark):
    v = Views(spark, SF)
    for out in (market.latest_quotes(v.quotes, v.spine, ["quote_seq"]), lineup.lineup_counts(lineup.availability_before(v.availability, v.spine), ["match_id", "cutoff_time", "team_id"])):
        assert "Generate" not in plan(out)


def test_match_block_keeps_rows_that_repeat_or_lack_a_side(spark, table):
    from cutline.operators.features import feature_table

    spine = table(
        [(1, "2020-03-10", "2020-03-09", "a", "b"), (1, "2020-03-10", "2020-03-09", "a", "b"), (1, "2020-03-10", "2020-03-09", "b", None), (2, "2020-03-10", "2020-03-09", "a", "b"),
         (None, "2020-03-10", "2020-03-09", "a", "b")],
        "match_id long, kickoff_at timestamp, cutoff_time timestamp, home_team_id string, away_team_id string",
    ).withColumns({"competition_id": F.lit("c"), "stage": F.lit("final"), "neutral_venue": F.lit(False)})
    results = table([], "match_id long, kickoff_at timestamp, home_team_id string, away_team_id string, home_goals_90 int, away_goals_90 int, home_advances boolean")
    ratings = table([], "team_id string, kickoff_at timestamp, rating double, seq long")
    quotes = table([(1, "x", "m", "Home", 2.0, "2020-03-01", False, 1), (1, "x", "m", "away", 4.0, "2020-03-02", False, 2)],
                   "match_id long, bookmaker string, market_type string, selection string, decimal_odds double, captured_at timestamp, is_live boolean, quote_seq long")
    records = table([(1, "a", "suspended", "goalkeeper", "2020-03-03"), (1, "b", "available", "coach", "2020-03-04"), (1, None, "available", "coach", "2020-03-05"), (None, "a", "available", "coach", "2020-03-05")],
                    "match_id long, team_id string, availability_status string, role string, published_at timestamp")
    out = feature_table(spine, results=results, ratings=ratings, quotes=quotes, availability=records, quote_order=["quote_seq"])
    got = sorted(((r["match_id"], r["home_team_id"], r["away_team_id"], r["market_bookmaker_count"], r["home_availability_count_suspended"], r["away_availability_count_available"],
                   r["confirmed_out_goalkeepers_diff"], r["source_data_max_timestamp"] and r["source_data_max_timestamp"].day) for r in out.collect()), key=str)
    assert got == [
        (1, "a", "b", 1, 1.0, 1.0, 1.0, 5), (1, "a", "b", 1, 1.0, 1.0, 1.0, 5), (1, "b", None, 1, 0.0, 0.0, 0.0, 5), (2, "a", "b", 0, 0.0, 0.0, 0.0, None), (None, "a", "b", 0, 0.0, 0.0, 0.0, None),
    ]


def test_fits_of_the_ledger_query_read_a_stored_table(spark, monkeypatch):
    from cutline.catalog import models
    from cutline.plans import prediction

    seen = []
    monkeypatch.setattr(models, "trained", lambda v, rows: seen.append(rows))
    monkeypatch.setattr(prediction, "predict", lambda rows, version, fitted: rows)
    v = Views(spark, SF)
    out = models.predict_ledger_rows(v)
    assert "Join" not in plan(seen[0]) and "_labels" not in out.columns
    labels = {r["match_id"]: int(r["home_advances"]) for r in v.results.collect()}
    assert {r["match_id"]: r["home_advances"] for r in seen[0].select("match_id", "home_advances").collect()} == labels
    assert out.count() == v.spine.count()
