"""Ledger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.operators import ledger as L
from cutline.session import checkpoint_dir
from cutline.sources import sinks as SS

REGISTRY = Registry()
query = REGISTRY.query

LED = """led AS (
  SELECT match_id, kickoff_at - INTERVAL 24 HOUR AS cutoff_time, ['v1', 'v10', 'v2'][1 + match_id % 3] AS model_version, home_team_id, away_team_id,
    market_probability, elo_probability, home_advance_probability AS calibrated_probability, home_advance_probability,
    1 - home_advance_probability AS away_advance_probability, CASE WHEN home_advance_probability >= 0.5 THEN home_team_id ELSE away_team_id END AS predicted_advancer_id,
    CASE WHEN home_advance_probability >= 0.62 OR home_advance_probability <= 1 - 0.62 THEN 'clear_lean'
      WHEN home_advance_probability >= 0.55 OR home_advance_probability <= 1 - 0.55 THEN 'slight_lean' ELSE 'near_coin_flip' END AS confidence_band,
    kickoff_at - INTERVAL 23 HOUR AS created_at, home_advances = 1 AS actual FROM scored)"""


def predictions(v):
    s = v.scored
    shift = lambda h: F.timestamp_seconds(F.unix_seconds("kickoff_at") - h * 3600)
    version = F.element_at(F.array(F.lit("v1"), F.lit("v10"), F.lit("v2")), (F.col("match_id") % 3 + 1).cast("int"))
    rows = s.select(
        "match_id", shift(24).alias("cutoff_time"), version.alias("model_version"), "home_team_id", "away_team_id",
        "market_probability", "elo_probability", F.lit(0.5).alias("base_probability"),
        F.col("home_advance_probability").alias("stacked_probability"),
        F.col("home_advance_probability").alias("calibrated_probability"), shift(23).alias("created_at"),
    )
    return L.prediction_rows(rows)


def outcomes(v):
    return v.scored.select("match_id", (F.col("home_advances") == 1).alias("home_advances"))


ROWS = """match_id, cutoff_time, model_version, round(home_advance_probability, 6) AS home_advance_probability, round(away_advance_probability, 6) AS away_advance_probability,
  predicted_advancer_id, confidence_band, round(market_probability, 6) AS market_probability, round(elo_probability, 6) AS elo_probability, created_at"""
ROW_COLS = [
    "match_id", "cutoff_time", "model_version", "home_advance_probability", "away_advance_probability", "predicted_advancer_id",
    "confidence_band", "market_probability", "elo_probability", "created_at",
]


@query("prediction_rows", f"WITH {LED} SELECT {ROWS} FROM led", ("scored",))
def prediction_rows(v):
    return predictions(v).select(*ROW_COLS)


@query("append_predictions", f"WITH {LED} SELECT {ROWS} FROM led WHERE model_version <> 'v2'", ("scored",))
def append_predictions(v):
    """New rows against a stored part of the ledger; none of them clashes."""
    p = predictions(v)
    return L.append_predictions(p.filter("model_version = 'v2'"), p.filter("model_version <> 'v2'")).select(*ROW_COLS)


@query(
    "ledger_conflicts",
    f"WITH {LED} SELECT match_id, cutoff_time, model_version FROM led WHERE confidence_band = 'clear_lean' AND model_version = 'v1'",
    ("scored",),
)
def ledger_conflicts(v):
    p = predictions(v)
    return L.conflicts(p.filter("confidence_band = 'clear_lean'"), p.filter("model_version = 'v1'"))


@query("ledger_export", f"WITH {LED} SELECT {ROWS} FROM led ORDER BY created_at DESC", ("scored",))
def ledger_export(v):
    """Export written as Parquet and read back."""
    path = f"{checkpoint_dir(v.spark)}/ledger-{uuid.uuid4().hex}"
    SS.write_predictions(predictions(v), path)
    return v.spark.read.parquet(path).select(*ROW_COLS)


@query(
    "list_predictions",
    f"WITH {LED} SELECT {ROWS} FROM led WHERE model_version = 'v10' AND cutoff_time >= TIMESTAMP '1999-01-01' ORDER BY created_at DESC",
    ("scored",),
)
def list_predictions(v):
    return L.list_predictions(predictions(v), model_version="v10", since=F.to_timestamp(F.lit("1999-01-01"))).select(*ROW_COLS)


EVAL = LED + """,
ev AS (
  SELECT match_id, model_version, actual AS actual_home_advances, -(CAST(actual AS INTEGER) * ln(q) + (1 - CAST(actual AS INTEGER)) * ln(1 - q)) AS log_loss,
    (q - CAST(actual AS INTEGER)) * (q - CAST(actual AS INTEGER)) AS brier_score, (home_advance_probability >= 0.5) = actual AS correct_classification
  FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, calibrated_probability)) AS q FROM led))"""


@query(
    "evaluate_predictions",
    f"""WITH {EVAL} SELECT model_version, actual_home_advances, correct_classification, count(*) AS n, round(avg(log_loss), 6) AS log_loss, round(avg(brier_score), 6) AS brier_score
    FROM ev GROUP BY ALL""",
    ("scored",),
)
def evaluate_predictions(v):
    e = L.evaluate(predictions(v), outcomes(v))
    return e.groupBy("model_version", "actual_home_advances", "correct_classification").agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier_score").alias("brier_score")
    )


@query(
    "prediction_evaluations",
    f"WITH {EVAL} SELECT match_id, ev.model_version, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, correct_classification FROM ev",
    ("scored",),
)
def prediction_evaluations(v):
    """Predictions joined with their evaluations."""
    p = predictions(v)
    e = L.evaluate(p, outcomes(v)).drop("model_version")
    return p.join(e, "prediction_id").select("match_id", "model_version", "log_loss", "brier_score", "correct_classification")


@query(
    "compare_model_versions",
    f"""WITH {EVAL} SELECT v AS model_version, count(model_version) AS n_predictions, round(avg(log_loss), 6) AS mean_log_loss, round(avg(brier_score), 6) AS mean_brier,
      round(avg(CAST(correct_classification AS DOUBLE)), 6) AS accuracy FROM (VALUES ('v1'), ('v2'), ('v3')) t(v) LEFT JOIN ev ON ev.model_version = v GROUP BY v""",
    ("scored",),
)
def compare_model_versions(v):
    p = predictions(v)
    wanted = v.spark.createDataFrame([("v1",), ("v2",), ("v3",)], "model_version string")
    return L.compare_versions(p, L.evaluate(p, outcomes(v)), wanted)


@query("latest_model_version", f"WITH {LED} SELECT confidence_band AS model_type, max(model_version) AS latest_version FROM led GROUP BY 1", ("scored",))
def latest_model_version(v):
    return L.latest_version(predictions(v).withColumnRenamed("confidence_band", "model_type"))


@query("model_versions", f"WITH {LED} SELECT DISTINCT confidence_band AS model_type, model_version FROM led", ("scored",))
def model_versions(v):
    return L.model_versions(predictions(v).withColumnRenamed("confidence_band", "model_type"))
