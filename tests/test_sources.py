from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cutline.operators import aliases as A
from cutline.operators import events as E
from cutline.operators import quality as Q
from cutline.sources import availability, event_files, matches, quotes, raw, results, sinks, tournaments


def test_match_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "ID, Date ,Tournament,round,season,Home_Team,away,home_score,away_score,winner,advancing_team,neutral,city\n"
        "1,2018-07-01T14:00:00Z,WC,Round of 16,2018,Spain,Russia,1,1,Draw,Russia,TRUE,\"Moscow, RU\"\n"
        "2,2018-07-02,WC,Group,2018,USA,Türkiye,2.0,0,usa,,no,X\n"
        "3,later,WC,Group,2018,A,B,1,0,A,,no,X\n"
        ",2018-07-03,WC,,,TBD,B,x,0,,,1,X\n", encoding="utf-8")
    good, bad = matches.read_matches_csv(spark, str(tmp_path / "m.csv"))
    rows = {r["match_id"]: r for r in good.collect()}
    assert rows["1"]["winner_team_id"] is None and rows["1"]["advancing_team_id"] == "russia" and rows["1"]["neutral_venue"]
    assert rows["1"]["city"] == "Moscow, RU"
    assert (rows["2"]["home_team_id"], rows["2"]["away_team_id"], rows["2"]["home_goals"]) == ("united_states", "turkiye", 2)
    made = next(r for k, r in rows.items() if k.startswith("MATCH_"))
    assert (made["home_team_id"], made["home_goals"], made["stage"], made["season_or_year"]) == ("home", None, "unknown", "2018")
    assert [(r["match_id"], r["reason"]) for r in bad.collect()] == [("3", "invalid_kickoff")]


def test_odds_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text(
        "match_id,bookmaker,market_type,selection,decimal_odds,captured_at,is_live,raw_payload_hash,published_at\n"
        "m1,A,home_to_advance, HOME ,1.55,2026-06-30T04:00:00Z,false,h1,\n"
        "m1,A,home_to_advance,away,1.0,2026-06-30T04:00:00Z,false,h2,\n"
        "m1,A,home_to_advance,away,2.0,noon,false,h3,\n"
        "m1,A,home_to_advance,away,2.5,2026-06-30T04:00:00Z,True,,2026-06-30T03:00:00Z\n")
    good, bad = quotes.read_odds_csv(spark, str(tmp_path / "o.csv"))
    r = sorted(good.collect(), key=lambda r: r["selection"], reverse=True)
    assert [x["selection"] for x in r] == ["home", "away"] and r[0]["ingested_at"] == r[0]["captured_at"]
    assert r[1]["is_live"] and len(r[1]["raw_payload_hash"]) == 64 and r[1]["published_at"] is not None
    assert sorted(x["reason"] for x in bad.collect()) == ["invalid_captured_at", "odds_not_above_one"]


def test_availability_json(spark, tmp_path):
    recs = [
        {"match_id": "m", "team_id": "france", "availability_status": "available", "observed_at": "2026-06-29T10:00:00Z"},
        {"match_id": "m", "team_id": "france", "availability_status": "available", "observed_at": "2026-06-29T10:00:00Z", "confidence": 1.5},
        {"match_id": "m", "team_id": "sweden", "role": "goalkeeper", "availability_status": "confirmed_out", "observed_at": "2026-07-01T03:00:00Z",
         "published_at": "2026-07-01T02:45:00Z", "cutoff_eligible": False, "confidence": 0.9},
    ]
    (tmp_path / "a.json").write_text(json.dumps(recs))
    good, bad = availability.read_availability_json(spark, str(tmp_path / "a.json"))
    r = {x["team_id"]: x for x in good.collect()}
    assert (r["france"]["confidence"], r["france"]["role"], r["france"]["cutoff_eligible"]) == (0.5, "unknown", True)
    assert r["france"]["published_at"] == r["france"]["observed_at"]
    assert r["sweden"]["published_at"] < r["sweden"]["observed_at"] and r["sweden"]["cutoff_eligible"] is False
    assert [x["reason"] for x in bad.collect()] == ["confidence_out_of_range"]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="must be a list"):
        availability.read_availability_json(spark, str(tmp_path / "b.json"))[0].collect()


def test_results_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral\n"
        "2022-12-18,Argentina,France,3,3,FIFA World Cup,Lusail,Qatar,TRUE\n2022-12-17,Croatia,Morocco,2,1,FIFA World Cup,,Qatar,TRUE\n"
        ",X,Y,1,0,F,,,\n2022-12-17,,Y,1,0,F,,,\n", encoding="utf-8")
    (tmp_path / "s.csv").write_text("date,home_team,away_team,winner\n2022-12-18,Argentina,France,France\n2022-12-18,argentina,FRANCE,Argentina\n")
    reg = A.builtin_registry(spark)
    good, bad = results.read_results_csv(spark, str(tmp_path / "r.csv"), reg)
    r = {x["home_team_id"]: x for x in good.collect()}
    assert r["argentina"]["match_id"] == "MJ42_argentina_france_2022-12-18" and r["argentina"]["winner_team_id"] is None
    assert (r["croatia"]["winner_team_id"], r["croatia"]["competition_id"], r["croatia"]["stage"]) == ("croatia", "fifa_world_cup", "unknown")
    assert sorted(x["reason"] for x in bad.collect()) == ["missing_date", "missing_team"]
    from cutline.operators.labels import results_with_shootouts

    so = results.read_shootouts_csv(spark, str(tmp_path / "s.csv"))
    got = {x["match_id"]: x["home_advances"] for x in results_with_shootouts(good, so, reg).collect()}
    assert got == {"MJ42_argentina_france_2022-12-18": True, "MJ42_croatia_morocco_2022-12-17": True}


def test_tournament_json_both_layouts(spark, tmp_path):
    a = {"name": "World Cup 2018", "rounds": [{"name": "Quarter-finals", "matches": [
        {"key": "QF 1", "date": "2018-07-06", "team1": {"name": "Brazil"}, "team2": {"name": "Belgium"}, "score1": 1, "score2": "2", "winner": 2},
        {"date": "2018-07-07", "team1": {"name": "Russia"}, "team2": {"name": "Croatia"}, "score1": 2, "score2": 2, "score1pen": 3, "score2pen": 4}]},
        {"matches": [{"date": "2018-07-08", "team1": None, "team2": {"name": "X"}}]}]}
    b = {"name": "World Cup 2022", "matches": [
        {"round": "Final", "date": "2022-12-18", "team1": "Argentina", "team2": "France", "score": {"ft": [2, 2], "et": [3, 3], "p": [4, 2]}, "ground": "Lusail"},
        {"round": "Group A", "date": "2022-11-20", "team1": "Qatar", "team2": "Ecuador", "score": {"ft": [True, 2]}}]}
    (tmp_path / "a.json").write_text(json.dumps(a, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(b))
    good, bad = tournaments.read_tournament_json(spark, str(tmp_path), A.builtin_registry(spark))
    r = {x["match_id"]: x for x in good.collect()}
    assert r["OF_qf_1"]["home_advances"] is False and r["OF_qf_1"]["stage"] == "Quarter-finals"
    assert r["OF_20180707_russia_croatia"]["home_advances"] is False
    f = r["OF_20221218_argentina_france"]
    assert (f["home_advances"], f["home_goals_et"], f["penalties_home"], f["neutral_venue"], f["competition_id"]) == (True, 3, 4, True, "world_cup_2022")
    assert r["OF_20221120_qatar_ecuador"]["home_goals"] is None and r["OF_20221120_qatar_ecuador"]["home_advances"] is None
    assert [x["reason"] for x in bad.collect()] == ["missing_team"]
    docs = tournaments.parse_documents(spark.read.text(str(tmp_path), wholetext=True))
    assert {x[0] for x in tournaments.tournament_teams(docs).collect()} == {"Brazil", "Belgium", "Russia", "Croatia", "X"}


def test_event_files(spark, tmp_path):
    shot = lambda team, xg, pattern: {"type": {"name": "Shot"}, "team": {"id": team}, "play_pattern": {"name": pattern}, "shot": {"statsbomb_xg": xg}}
    for mid, day in (("7", "2020-01-01"), ("8", "2020-02-01"), ("9", "2020-03-01")):
        d = tmp_path / "matches" / "43" / "3"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{mid}.json").write_text(json.dumps({"match_date": day, "home_team": {"id": 1}, "away_team": {"id": 2}}))
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "7.json").write_text(json.dumps([shot(1, 0.2, "From Corner"), shot(1, 0.1, "Regular Play"), shot(2, None, "From Corner"), {"type": {"name": "Pass"}}]))
    (tmp_path / "events" / "8.json").write_text(json.dumps([shot(2, 0.5, "From Free Kick")]))
    (tmp_path / "events" / "9.json").write_text("{not json")
    meta, events = event_files.read_events(spark, str(tmp_path))
    f = {r["match_id"]: r for r in E.event_match_features(events, meta.drop("match_at")).collect()}
    assert (f["7"]["xg_home"], f["7"]["shots_home"], f["7"]["set_piece_xg_home"], f["7"]["shots_in_box_away"]) == (0.3, 2.0, 0.2, 1.0)
    assert f["9"]["events_available"] == 0.0 and f["9"]["xg_home"] == 0.0
    cuts = spark.createDataFrame([("1", "2020-02-01"), ("2", "2020-02-02"), ("1", "2020-01-01")], "team_id string, d string").select(
        "team_id", F.to_timestamp("d").alias("cutoff_time"))
    t = {(r["team_id"], r["cutoff_time"].month, r["cutoff_time"].day): r for r in E.event_team_totals(events, meta, cuts).collect()}
    assert (t["1", 2, 1]["xg_total"], t["1", 2, 1]["matches_used"]) == (0.3, 1.0)
    assert (t["2", 2, 2]["xg_total"], t["2", 2, 2]["shots_total"], t["2", 2, 2]["matches_used"]) == (0.5, 2.0, 2.0)
    assert t["1", 1, 1]["xg_total"] is None and t["1", 1, 1]["events_available"] == 0.0
    cov = {r["match_id"]: tuple(r)[1:] for r in E.event_coverage(meta.drop("match_at"), events).collect()}
    assert cov["7"] == (True, True, True, True) and cov["9"] == (True, False, False, False)


def test_check_schema(spark):
    raw.check_schema(spark.range(1), ["id"])
    with pytest.raises(ValueError, match="missing columns: a, b"):
        raw.check_schema(spark.range(1), ["b", "id", "a"])


def test_sinks_and_content_hash(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    for fmt in ("parquet", "csv", "json"):
        sinks.write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 10
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "v"]
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "xml")
    sinks.write_report(str(tmp_path / "run"), df, df.limit(2), df.limit(1))
    assert spark.read.json(str(tmp_path / "run" / "folds_json")).count() == 2
    sinks.write_manifest(str(tmp_path / "man"), {"manifest": df, "quarantine": df.limit(3)})
    assert spark.read.json(str(tmp_path / "man" / "quarantine")).count() == 3
    sinks.export_query(spark, "SELECT 1 AS one", str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).first()["one"] == 1
    (tmp_path / "f.bin").write_bytes(b"abc")
    h = Q.content_hashes(spark.read.format("binaryFile").load(str(tmp_path / "f.bin")))
    assert h.first()["actual_sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_synthetic_matches_do_not_depend_on_partitioning(spark):
    a = sinks.synthetic_matches(spark.range(50)).collect()
    b = sinks.synthetic_matches(spark.range(50).repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert all(r["home_team_id"] != r["away_team_id"] for r in a)
