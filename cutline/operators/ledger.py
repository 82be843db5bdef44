"""Append-only prediction ledger and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import probability as P
from cutline.functions.hashing import stable_hash

LEDGER_KEY = ["match_id", "cutoff_time", "model_version"]
EXPORT_COLUMNS = [
    "prediction_id", "match_id", "cutoff_time", "model_version", "home_advance_probability",
    "away_advance_probability", "predicted_advancer_id", "confidence_band", "market_probability",
    "elo_probability", "base_probability", "stacked_probability", "calibrated_probability",
    "immutable_hash", "created_at",
]


def prediction_rows(scored: DataFrame, clear_min: float = 0.62, slight_min: float = 0.55) -> DataFrame:
    """Ledger rows from scored matches (with ``calibrated_probability`` and both team ids).

    The id is derived from the key, so a repeated task writes the same row.
    """
    p = F.col("calibrated_probability")
    rows = scored.withColumns({
        "home_advance_probability": p,
        "away_advance_probability": 1.0 - p,
        "predicted_advancer_id": F.when(p >= 0.5, F.col("home_team_id")).otherwise(F.col("away_team_id")),
        "confidence_band": P.confidence_band(p, clear_min, slight_min),
        "status": F.lit("active"),
    })
    hashed = [*LEDGER_KEY, "calibrated_probability", "predicted_advancer_id", "confidence_band"]
    ident = F.concat(F.lit("pred_"), F.substring(stable_hash(LEDGER_KEY), 1, 16))
    return rows.withColumns({"immutable_hash": stable_hash(hashed), "prediction_id": ident})


def conflicts(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose key is already stored or occurs twice in the batch."""
    stored = new.select(*LEDGER_KEY).join(ledger.select(*LEDGER_KEY), LEDGER_KEY, "left_semi").distinct()
    twice = new.groupBy(*LEDGER_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*LEDGER_KEY)
    return stored.unionByName(twice).distinct()


def append_predictions(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append; a key that exists already fails the job, nothing is overwritten."""
    seen = ledger.select(*LEDGER_KEY).distinct().withColumn("_seen", F.lit(True))
    twice = new.groupBy(*LEDGER_KEY).agg((F.count(F.lit(1)) > 1).alias("_twice"))
    j = new.join(seen, LEDGER_KEY, "left").join(twice, LEDGER_KEY)
    clash = F.col("_seen").isNotNull() | F.col("_twice")
    text = F.concat_ws(" ", F.lit("Prediction already exists:"), *[F.col(c).cast("string") for c in LEDGER_KEY])
    guarded = j.withColumn("_g", F.when(clash, F.raise_error(text).cast("string")))
    return guarded.filter(F.col("_g").isNull()).drop("_seen", "_twice", "_g")


def evaluate(predictions: DataFrame, outcomes: DataFrame, evaluated_at: Column | None = None) -> DataFrame:
    """One evaluation row per prediction with an outcome (match_id, home_advances).

    The clip bound differs from the report metrics: 1e-6.
    """
    at = F.current_timestamp() if evaluated_at is None else evaluated_at
    p = P.clip("calibrated_probability")
    y = F.col("home_advances").cast("double")
    hit = (F.col("home_advance_probability") >= 0.5) == F.col("home_advances")
    j = predictions.join(outcomes.select("match_id", "home_advances"), "match_id").filter(
        F.col("home_advances").isNotNull()
    )
    return j.select(
        "prediction_id",
        "model_version",
        F.col("home_advances").alias("actual_home_advances"),
        P.log_loss_row(p, y, P.METRIC_EPS).alias("log_loss"),
        P.brier_row(p, y).alias("brier_score"),
        hit.alias("correct_classification"),
        at.alias("evaluated_at"),
    )


def compare_versions(predictions: DataFrame, evaluations: DataFrame, versions: DataFrame) -> DataFrame:
    """Mean metrics of every requested version (column model_version); n = 0 where none exist."""
    j = predictions.select("prediction_id", "model_version").join(
        evaluations.drop("model_version"), "prediction_id"
    )
    per = j.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("log_loss").alias("mean_log_loss"),
        F.avg("brier_score").alias("mean_brier"),
        F.avg(F.col("correct_classification").cast("double")).alias("accuracy"),
    )
    return versions.join(per, "model_version", "left").select(
        "model_version", F.coalesce("n", F.lit(0)).alias("n_predictions"), "mean_log_loss", "mean_brier", "accuracy"
    )


def list_predictions(
    ledger: DataFrame,
    *,
    match_id=None,
    model_version: str | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Filtered listing, newest first."""
    out = ledger
    if match_id is not None:
        out = out.filter(F.col("match_id") == match_id)
    if model_version is not None:
        out = out.filter(F.col("model_version") == model_version)
    if since is not None:
        out = out.filter(F.col("cutoff_time") >= since)
    return out.orderBy(F.col("created_at").desc(), "prediction_id")


def ledger_export(ledger: DataFrame, match_id=None) -> DataFrame:
    return list_predictions(ledger, match_id=match_id).select(*EXPORT_COLUMNS)


def model_versions(runs: DataFrame) -> DataFrame:
    """Sorted distinct versions per model type."""
    return runs.select("model_type", "model_version").distinct().orderBy("model_type", "model_version")


def latest_version(runs: DataFrame) -> DataFrame:
    """Lexicographically last version per model type."""
    return runs.groupBy("model_type").agg(F.max("model_version").alias("latest_version"))
