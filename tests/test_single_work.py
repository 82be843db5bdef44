"""Work that a plan must do once: copies of it grow shuffles, memory and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.operators import aliases as A
from cutline.operators import folds, manifest, market
from cutline.sources import tournaments as ST


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotes_before_is_not_salted(spark):
    quotes = spark.createDataFrame([(1, 10, "a"), (1, 30, "b"), (2, 10, "c")], "match_id long, captured_at long, q string")
    cuts = spark.createDataFrame([(1, 20), (1, 20), (1, 40), (3, 99)], "match_id long, cutoff_time long")
    out = market.quotes_before(quotes, cuts)
    assert sorted((r.match_id, r.q, r.cutoff_time) for r in out.collect()) == [(1, "a", 20), (1, "a", 40), (1, "b", 40)]
    assert "Generate" not in plan(out)


def test_mirror_augment_reads_its_table_once(spark):
    df = spark.createDataFrame([(1, "x", "y", 0.25, 2.0, 1, True), (2, "p", "q", None, None, None, None)],
                               "id long, home string, away string, p double, d_diff double, n int, b boolean")
    out = folds.mirror_augment(df, swap=[("home", "away")], negate=["d_diff"], complement=["p"], flip=["n", "b"])
    assert out.columns == [*df.columns, "is_mirror"]
    assert sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[-1])) == [
        (1, "x", "y", 0.25, 2.0, 1, True, False), (1, "y", "x", 0.75, -2.0, 0, False, True),
        (2, "p", "q", None, None, None, None, False), (2, "q", "p", None, None, None, None, True),
    ]
    assert "Union" not in plan(out)


def test_fixtures_meet_winners_once(spark):
    cols = "provider string, provider_rank int, ordinal long, match_id long, kickoff_at long, competition_id string, tournament string, stage string, season_or_year string, home_team_id string, away_team_id string"
    fixtures = spark.createDataFrame([(f"p{r}", r, r, 1, 5, "c", "t", "Final", "1990", "x", "y") for r in range(3)], cols)
    results = spark.createDataFrame([(f"p{r}", 1, r, 2, 1, True) for r in range(1, 3)], "provider string, match_id long, ordinal long, home_goals_90 int, away_goals_90 int, home_advances boolean")
    out = manifest.classify_fixtures(fixtures, results)
    assert {r.provider: r.reason for r in out.collect()} == {"p0": "missing_result", "p1": None, "p2": "duplicate_across_providers"}
    assert "Generate" not in plan(out)


def test_names_are_folded_once_and_only_where_they_have_accents(spark):
    docs = spark.createDataFrame([('{"name": "Cup São 1", "matches": [{"date": "2001-02-03", "team1": "Türkiye", "team2": "New  Town", "score": {"ft": [1, 0]}}]}',)], "value string")
    good, _ = ST.parse_tournaments(ST.parse_documents(docs), A.builtin_registry(spark))
    r = good.first()
    assert (r.match_id, r.home_team_id, r.away_team_id, r.competition_id) == ("OF_20010203_turkiye_new_town", "turkiye", "new_town", "cup_sao_1")
    text = plan(good.select("match_id", "home_team_id", "away_team_id"))
    assert text.count("translate(lower(btrim(home_team") <= 1 and text.count("octet_length(lower(btrim(home_team") <= 1
    from cutline.functions.names import strip_accents

    plain = plan(spark.range(1).select(strip_accents(F.concat(F.col("id").cast("string"), F.lit("x"))).alias("s")))
    assert "octet_length" in plain
