"""Match files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.names import is_blank, trim_all
from cutline.functions.timeutil import to_utc
from cutline.operators.aliases import builtin_registry, resolve_strict
from cutline.sources.raw import ensure_columns, read_csv, rename_aliases, to_bool, to_int

# Accepted header names.
MATCH_COLUMNS = {
    "match_id": ("match_id", "id"),
    "kickoff_at": ("date", "kickoff", "kickoff_at", "match_date"),
    "competition_id": ("tournament", "competition", "competition_id"),
    "stage": ("stage", "round"),
    "season_or_year": ("season", "year", "season_or_year"),
    "home_team_id": ("home_team", "home", "home_team_id"),
    "away_team_id": ("away_team", "away", "away_team_id"),
    "home_goals": ("home_score", "home_goals"),
    "away_goals": ("away_score", "away_goals"),
    "winner_team_id": ("winner", "winner_team_id"),
    "advancing_team_id": ("advancing_team", "advancing_team_id"),
    "neutral_venue": ("neutral", "neutral_venue"),
    "venue_name": ("venue", "venue_name"),
    "city": ("city",),
    "country": ("country",),
    "source": ("source",),
}
# Words that stand for "no team".
NO_TEAM = ("draw", "tbd", "n/a", "unknown")
TEAM_COLUMNS = ("home_team_id", "away_team_id", "winner_team_id", "advancing_team_id")


def parse_matches(raw: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, quarantine) from a table of text columns.

    A row without a readable kickoff is quarantined with a reason.
    """
    df = ensure_columns(rename_aliases(raw, MATCH_COLUMNS), list(MATCH_COLUMNS))
    content = [c for c in sorted(MATCH_COLUMNS) if c in df.columns]
    fallback = F.concat(F.lit("MATCH_"), F.substring(F.sha2(F.to_json(F.struct(*content)), 256), 1, 16))
    df = df.withColumn("_kick", to_utc("kickoff_at"))
    bad = df.filter(F.col("_kick").isNull()).withColumn(
        "reason", F.when(is_blank("kickoff_at"), "missing_kickoff").otherwise("invalid_kickoff")
    ).drop("_kick")
    reg = registry if registry is not None else builtin_registry(raw.sparkSession, strict=True)
    good = df.filter(F.col("_kick").isNotNull()).withColumn(
        "match_id", F.when(is_blank("match_id"), fallback).otherwise(F.col("match_id"))
    )
    for c in TEAM_COLUMNS:
        blank = is_blank(c) | F.lower(trim_all(c)).isin(*NO_TEAM)
        good = resolve_strict(good, c, reg, out="_id").withColumn(c, F.when(~blank, F.col("_id"))).drop("_id", "_id_queued")
    absent = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    out = good.select(
        "match_id",
        F.col("_kick").alias("kickoff_at"),
        absent("competition_id", "unknown").alias("competition_id"),
        absent("stage", "unknown").alias("stage"),
        F.coalesce("season_or_year", F.year("_kick").cast("string")).alias("season_or_year"),
        absent("home_team_id", "home").alias("home_team_id"),
        absent("away_team_id", "away").alias("away_team_id"),
        to_int("home_goals").alias("home_goals"),
        to_int("away_goals").alias("away_goals"),
        "winner_team_id",
        "advancing_team_id",
        to_bool("neutral_venue").alias("neutral_venue"),
        "venue_name",
        "city",
        "country",
        absent("source", "local").alias("source"),
        *(["ordinal"] if "ordinal" in good.columns else []),
    )
    return out, bad


def read_matches_csv(spark: SparkSession, path: str, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_matches(read_csv(spark, path), registry)
