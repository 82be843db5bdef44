"""Sinks and derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators.ledger import ledger_export


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_predictions(ledger: DataFrame, path: str, fmt: str = "parquet", match_id=None, mode: str = "errorifexists") -> None:
    write_table(ledger_export(ledger, match_id), path, fmt, mode)


def export_query(spark: SparkSession, sql: str, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    write_table(spark.sql(sql), path, fmt, mode)


def write_report(path: str, predictions: DataFrame, folds: DataFrame, summary: DataFrame) -> None:
    """Per-prediction CSV and Parquet, per-fold and summary JSON of one run."""
    write_table(predictions, f"{path}/predictions_csv", "csv")
    write_table(predictions, f"{path}/predictions_parquet", "parquet")
    write_table(folds, f"{path}/folds_json", "json")
    write_table(summary, f"{path}/summary_json", "json")


def write_manifest(path: str, tables: dict[str, DataFrame]) -> None:
    """One JSON table per artifact: manifest, quarantine, third place, expected against found."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", "json")


def synthetic_matches(ids: DataFrame, seed: int = 42, n_teams: int = 32) -> DataFrame:
    """One weekly match per ``id`` with hashed teams and goals; a draw gets a hashed advancer.

    ``ids`` is any table with a whole-number ``id`` (``spark.range(n)`` for n matches). Every value
    derives from (id, seed), so any partitioning yields the same rows.
    """
    h = lambda salt, mod: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(mod))
    home = h("home", n_teams)
    away = F.pmod(home + 1 + h("away", n_teams - 1), F.lit(n_teams))
    df = ids.select("id").withColumns({"_h": home, "_a": away, "_hg": h("hg", 5).cast("int"), "_ag": h("ag", 5).cast("int")})
    name = lambda c: F.concat(F.lit("team_"), F.lpad(F.col(c).cast("string"), 3, "0"))
    adv = (F.when(F.col("_hg") > F.col("_ag"), True).when(F.col("_hg") < F.col("_ag"), False)
           .otherwise(h("adv", 2) == 0))
    start = F.to_timestamp(F.lit("2010-01-02 18:00:00"))
    return df.select(
        F.concat(F.lit("SYN_"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("match_id"),
        F.timestamp_seconds(F.unix_seconds(start) + F.col("id") * 7 * 86400).alias("kickoff_at"),
        name("_h").alias("home_team_id"),
        name("_a").alias("away_team_id"),
        F.col("_hg").alias("home_goals_90"),
        F.col("_ag").alias("away_goals_90"),
        adv.alias("home_advances"),
        F.lit(True).alias("neutral_venue"),
    )
