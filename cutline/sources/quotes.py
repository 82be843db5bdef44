"""Odds files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.hashing import stable_hash
from cutline.functions.names import is_blank, trim_all
from cutline.functions.timeutil import to_utc
from cutline.sources.raw import ensure_columns, read_csv, rename_aliases

ODDS_COLUMNS = [
    "match_id", "bookmaker", "market_type", "selection", "decimal_odds", "captured_at", "source",
    "is_live", "currency_or_region", "source_name", "source_record_id", "source_url",
    "published_at", "ingested_at", "effective_at", "raw_payload_hash", "source_version",
]
LIVE_WORDS = ("1", "true", "t", "yes")


def parse_odds(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, quarantine). Ingest and effect times default to the capture time, the hash to the
    content hash of the row; odds must be above 1."""
    df = rename_aliases(raw, {})
    content = [c for c in df.columns if c in ODDS_COLUMNS]
    own_hash = stable_hash(content)
    if "raw_payload_hash" in df.columns:
        own_hash = F.when(is_blank("raw_payload_hash"), own_hash).otherwise(F.col("raw_payload_hash"))
    df = ensure_columns(df.withColumn("raw_payload_hash", own_hash), ODDS_COLUMNS)
    text = lambda c, v: trim_all(F.coalesce(F.col(c), F.lit(v)))
    at = to_utc("captured_at")
    df = df.withColumns({"_at": at, "_odds": trim_all("decimal_odds").try_cast("double")})
    reason = (
        F.when(F.col("_at").isNull(), "invalid_captured_at")
        .when(F.col("_odds").isNull(), "invalid_decimal_odds")
        .when(~(F.col("_odds") > 1.0), "odds_not_above_one")
        .when(is_blank("match_id") | is_blank("market_type") | is_blank("selection"), "missing_field")
    )
    marked = df.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).select(
        trim_all("match_id").alias("match_id"),
        text("bookmaker", "unknown").alias("bookmaker"),
        trim_all("market_type").alias("market_type"),
        F.lower(trim_all("selection")).alias("selection"),
        F.col("_odds").alias("decimal_odds"),
        F.col("_at").alias("captured_at"),
        F.coalesce("source", F.lit("local")).alias("source"),
        F.coalesce(F.lower(trim_all("is_live")).isin(*LIVE_WORDS), F.lit(False)).alias("is_live"),
        "currency_or_region",
        F.coalesce("source_name", F.lit("local")).alias("source_name"),
        "source_record_id",
        "source_url",
        to_utc("published_at").alias("published_at"),
        F.coalesce(to_utc("ingested_at"), "_at").alias("ingested_at"),
        F.coalesce(to_utc("effective_at"), "_at").alias("effective_at"),
        "raw_payload_hash",
        "source_version",
        *(["ordinal"] if "ordinal" in marked.columns else []),
    )
    return good, marked.filter(F.col("reason").isNotNull()).drop("_at", "_odds")


def read_odds_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_odds(read_csv(spark, path))
