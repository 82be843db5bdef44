"""International result and shootout files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.names import canonical_key, is_blank, slug, trim_all
from cutline.functions.timeutil import to_utc
from cutline.operators.aliases import resolve_teams
from cutline.sources.raw import ensure_columns, read_csv, rename_aliases, to_bool, to_int

# Accepted header names.
RESULT_COLUMNS = {
    "date": ("date",),
    "home_team": ("home_team", "home", "home_team_name"),
    "away_team": ("away_team", "away", "away_team_name"),
    "home_score": ("home_score", "home_goals"),
    "away_score": ("away_score", "away_goals"),
    "tournament": ("tournament", "competition"),
    "city": ("city",),
    "country": ("country",),
    "neutral": ("neutral", "neutral_venue"),
}
SHOOTOUT_COLUMNS = {
    "date": ("date",),
    "home_team": ("home_team", "home", "home_team_name"),
    "away_team": ("away_team", "away", "away_team_name"),
    "winner": ("winner", "winning_team"),
}
ID_PREFIX = "MJ42_"


def parse_results(raw: DataFrame, registry: DataFrame, source: str = "results") -> tuple[DataFrame, DataFrame]:
    """(matches, quarantine). The date is UTC midnight, the stage unknown, a winner exists only
    where the scores differ."""
    df = ensure_columns(rename_aliases(raw, RESULT_COLUMNS), list(RESULT_COLUMNS))
    df = df.withColumns({
        "_kick": to_utc("date"),
        "_home": trim_all("home_team"),
        "_away": trim_all("away_team"),
        "_hg": to_int("home_score"),
        "_ag": to_int("away_score"),
    })
    reason = (
        F.when(is_blank("date"), "missing_date")
        .when(F.col("_kick").isNull(), "invalid_date")
        .when(is_blank("_home") | is_blank("_away"), "missing_team")
    )
    marked = df.withColumn("reason", reason)
    good = resolve_teams(
        marked.filter(F.col("reason").isNull()), {"_home": "home_team_id", "_away": "away_team_id"}, registry
    )
    ident = F.concat_ws("_", canonical_key("_home"), canonical_key("_away"), trim_all("date"))
    name = F.nullif(trim_all("tournament"), F.lit(""))
    winner = F.when(F.col("_hg") > F.col("_ag"), F.col("home_team_id")).when(
        F.col("_hg") < F.col("_ag"), F.col("away_team_id")
    )
    out = good.select(
        F.concat(F.lit(ID_PREFIX), F.regexp_replace(ident, r"[^0-9A-Za-z_\-]", "_")).alias("match_id"),
        F.col("_kick").alias("kickoff_at"),
        F.col("date").alias("raw_date"),
        F.col("_home").alias("home_team"),
        F.col("_away").alias("away_team"),
        slug(F.coalesce(name, F.lit("unknown"))).alias("competition_id"),
        F.lit("unknown").alias("stage"),
        F.year("_kick").cast("string").alias("season_or_year"),
        "home_team_id",
        "away_team_id",
        F.col("_hg").alias("home_goals"),
        F.col("_ag").alias("away_goals"),
        winner.alias("winner_team_id"),
        to_bool("neutral").alias("neutral_venue"),
        F.nullif("city", F.lit("")).alias("city"),
        F.nullif("country", F.lit("")).alias("country"),
        F.lit(source).alias("source"),
        *(["ordinal"] if "ordinal" in good.columns else []),
    )
    return out, marked.filter(F.col("reason").isNotNull()).drop("_kick", "_home", "_away", "_hg", "_ag")


def parse_shootouts(raw: DataFrame) -> DataFrame:
    return ensure_columns(rename_aliases(raw, SHOOTOUT_COLUMNS), list(SHOOTOUT_COLUMNS))


def read_results_csv(spark: SparkSession, path: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parse_results(read_csv(spark, path), registry)


def read_shootouts_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_shootouts(read_csv(spark, path))
