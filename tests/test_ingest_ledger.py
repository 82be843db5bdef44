from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cutline.operators import ingest as I
from cutline.operators import ledger as L

MATCH = "match_id string, kickoff_at timestamp, home_team_id string, away_team_id string, stage string, o int"


def test_upsert_keeps_kickoff_and_teams(table):
    stored = table([("m1", "2020-01-01", "a", "b", "Group", 0)], MATCH).drop("o")
    batch = table([("m1", "2020-05-05", "x", "y", "Final", 1), ("m2", "2020-02-02", "c", "d", "A", 1), ("m2", "2020-03-03", "e", "f", "B", 2)], MATCH)
    r = {x["match_id"]: x for x in I.upsert_matches(stored, batch, ["o"]).collect()}
    assert (r["m1"]["kickoff_at"].month, r["m1"]["home_team_id"], r["m1"]["stage"], r["m1"]["inserted"]) == (1, "a", "Final", False)
    assert (r["m2"]["kickoff_at"].month, r["m2"]["home_team_id"], r["m2"]["stage"], r["m2"]["inserted"]) == (2, "c", "B", True)


def test_append_is_idempotent_and_first_wins(table):
    schema = "raw_payload_hash string, v int"
    empty = table([], schema)
    batch = table([("h", 1), ("h", 2), ("i", 3)], schema)
    new = I.append_new(empty, batch, order=["v"])
    assert sorted(map(tuple, new.collect())) == [("h", 1), ("i", 3)]
    assert I.append_new(new, batch, order=["v"]).count() == 0


def test_upsert_results_replaces(table):
    schema = "match_id string, home_advances boolean, o int"
    got = I.upsert_results(table([("a", True, 0), ("b", True, 0)], schema), table([("a", True, 1), ("a", False, 2), ("c", True, 1)], schema), ["o"])
    assert sorted((r["match_id"], r["home_advances"]) for r in got.collect()) == [("a", False), ("b", True), ("c", True)]


def test_unknown_columns_are_rejected(spark):
    with pytest.raises(ValueError, match="extra"):
        I.reject_unknown_columns(spark.range(1).withColumn("extra", F.lit(1)), ["id"])


def test_validation_names_every_failure(table):
    df = table([("m", 0.5, None), ("m", 2.0, "2020-01-01")], "match_id string, decimal_odds double, captured_at timestamp")
    good, bad = I.validate_odds(df)
    assert good.count() == 1 and bad.first()["reasons"] == ["odds_not_above_one", "captured_at_missing"]


def test_stored_snapshots_are_never_rebuilt(table):
    asked = table([("m1", "2020-01-01"), ("m2", "2020-01-01"), ("m1", "2020-01-01")], "match_id string, cutoff_time timestamp")
    seen = []

    def build(spine):
        seen.append(sorted(r["match_id"] for r in spine.collect()))
        return spine.withColumns({"f": F.lit(1.5), "source_data_max_timestamp": F.col("cutoff_time")})

    empty = I.make_snapshots(build(asked.limit(0)), "v1", ["f"])
    first = I.build_or_get(asked.filter("match_id = 'm1'"), empty, build, "v1", ["f"])
    again = I.build_or_get(asked, first, build, "v1", ["f"])
    assert seen[1:] == [["m1"], ["m2"]] and again.count() == 2
    a = {r["match_id"]: r["immutable_hash"] for r in again.collect()}
    assert a["m1"] == first.first()["immutable_hash"] != a["m2"]


@pytest.fixture
def scored(table):
    df = table([("m1", "2020-01-01", "v1", "a", "b", 0.7), ("m2", "2020-01-02", "v1", "c", "d", 0.5), ("m3", "2020-01-02", "v2", "c", "d", 0.3)],
               "match_id string, cutoff_time timestamp, model_version string, home_team_id string, away_team_id string, calibrated_probability double")
    return L.prediction_rows(df)


def test_prediction_rows(scored):
    r = {x["match_id"]: x for x in scored.collect()}
    assert (r["m1"]["predicted_advancer_id"], r["m1"]["confidence_band"]) == ("a", "clear_lean")
    assert r["m2"]["predicted_advancer_id"] == "c" and r["m3"]["away_advance_probability"] == pytest.approx(0.7)
    assert len({x["prediction_id"] for x in r.values()}) == 3


def test_duplicates_raise(scored):
    stored = scored.filter("match_id = 'm1'")
    assert L.append_predictions(stored, scored.filter("match_id <> 'm1'")).count() == 2
    with pytest.raises(Exception, match="Prediction already exists"):
        L.append_predictions(stored, scored).collect()
    with pytest.raises(Exception, match="Prediction already exists"):
        L.append_predictions(stored.limit(0), stored.unionByName(stored)).collect()
    assert [r["match_id"] for r in L.conflicts(stored, scored).collect()] == ["m1"]


def test_evaluation_and_version_comparison(scored, table):
    import math

    out = table([("m1", True), ("m3", True), ("m2", None)], "match_id string, home_advances boolean")
    e = L.evaluate(scored, out)
    r = {x["model_version"]: x for x in e.collect()}
    assert r["v1"]["log_loss"] == pytest.approx(-math.log(0.7)) and r["v1"]["correct_classification"]
    assert r["v2"]["brier_score"] == pytest.approx(0.49) and not r["v2"]["correct_classification"]
    c = {x["model_version"]: x for x in L.compare_versions(scored, e, table([("v1",), ("v9",)], "model_version string")).collect()}
    assert (c["v1"]["n_predictions"], c["v9"]["n_predictions"], c["v9"]["mean_log_loss"]) == (1, 0, None)


def test_stream_append_equals_batch_append(spark, tmp_path):
    from cutline.streaming.append import append_sink

    schema = "raw_payload_hash string, v int"
    for i, part in enumerate(([("a", 1), ("b", 2)], [("b", 9), ("c", 3), ("c", 4)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream
             .foreachBatch(append_sink(str(tmp_path / "out"), order=["v"]))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1), ("b", 2), ("c", 3)]
