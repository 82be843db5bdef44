"""Batch prediction: features -> components -> stack -> calibrate -> explain -> ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import probability as P
from cutline.functions.rules import explain
from cutline.operators.ledger import append_predictions, prediction_rows
from cutline.plans.training import Trained


def score(features: DataFrame, trained: Trained | None = None) -> DataFrame:
    """All probabilities of each row. Without fitted models: base 0.5, fixed blend, clipped."""
    if trained is not None:
        return trained.score(features)
    base = features.withColumns({
        "base_probability": F.lit(0.5), "elo_probability": F.col("elo_home_advance_probability"),
    })
    stacked = base.withColumn("stacked_probability", P.blend("market_probability", "elo_probability", "base_probability"))
    return stacked.withColumn("calibrated_probability", P.clip("stacked_probability"))


def with_explanation(scored: DataFrame) -> DataFrame:
    lineup = F.greatest("home_lineup_confirmed", "away_lineup_confirmed") > 0
    return scored.withColumn("_lineup", lineup).withColumn(
        "explanation",
        explain("elo_difference", "market_probability", "confirmed_out_midfielders_diff", "_lineup", "events_available"),
    ).drop("_lineup")


def predict(
    features: DataFrame, version: str, trained: Trained | None = None, *, clear_min: float = 0.62, slight_min: float = 0.55
) -> DataFrame:
    """Ledger-ready predictions of a whole feature table."""
    rows = with_explanation(score(features, trained)).withColumn("model_version", F.lit(version))
    return prediction_rows(rows, clear_min, slight_min).select(
        "prediction_id", "match_id", "cutoff_time", "kickoff_at", "model_version", "home_team_id", "away_team_id",
        "market_probability", "elo_probability", "base_probability", "stacked_probability", "calibrated_probability",
        "home_advance_probability", "away_advance_probability", "predicted_advancer_id", "confidence_band", "status",
        "explanation", "immutable_hash",
    )


def predict_and_append(ledger: DataFrame, features: DataFrame, version: str, trained: Trained | None = None) -> DataFrame:
    """Rows to append to the ledger; an existing (match, cut-off, version) fails the job."""
    return append_predictions(ledger, predict(features, version, trained))
