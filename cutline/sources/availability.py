"""Availability documents: a JSON array of records per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.hashing import stable_hash
from cutline.functions.timeutil import to_utc

RECORD_SCHEMA = (
    "match_id string, team_id string, player_id string, role string, availability_status string, "
    "confidence string, published_at string, cutoff_eligible string, source string, "
    "raw_text string, source_name string, source_record_id string, source_url string, "
    "observed_at string, ingested_at string, effective_at string, raw_payload_hash string, "
    "source_version string"
)
RECORD_FIELDS = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]


def parse_availability(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) from text fields; times default to ``observed_at``."""
    df = records.withColumns({"_hash": stable_hash(RECORD_FIELDS), "_obs": to_utc("observed_at")})
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.when(F.col("confidence").isNull(), 0.5))
    df = df.withColumn("_conf", conf)
    reason = (
        F.when(F.col("_obs").isNull(), "invalid_observed_at")
        .when(~F.coalesce(F.col("_conf").between(0.0, 1.0), F.lit(False)), "confidence_out_of_range")
        .when(F.col("match_id").isNull() | F.col("team_id").isNull() | F.col("availability_status").isNull(), "missing_field")
    )
    marked = df.withColumn("reason", reason)
    or_obs = lambda c: F.coalesce(to_utc(c), "_obs").alias(c)
    good = marked.filter(F.col("reason").isNull()).select(
        "match_id",
        "team_id",
        "player_id",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        "availability_status",
        F.col("_conf").alias("confidence"),
        or_obs("published_at"),
        F.coalesce(F.lower("cutoff_eligible") != "false", F.lit(True)).alias("cutoff_eligible"),
        F.coalesce("source", F.lit("local")).alias("source"),
        "raw_text",
        F.coalesce("source_name", F.lit("local")).alias("source_name"),
        "source_record_id",
        "source_url",
        F.col("_obs").alias("observed_at"),
        or_obs("ingested_at"),
        or_obs("effective_at"),
        F.coalesce("raw_payload_hash", "_hash").alias("raw_payload_hash"),
        "source_version",
    )
    return good, marked.filter(F.col("reason").isNotNull()).drop("_hash", "_obs", "_conf")


def parse_documents(docs: DataFrame, doc: str = "value") -> DataFrame:
    """Explode JSON array texts into records; a document that is not a list fails the job."""
    text = F.trim(F.col(doc))
    guard = F.when(
        ~F.startswith(text, F.lit("[")),
        F.raise_error(F.lit("Availability JSON must be a list of records")).cast("string"),
    ).otherwise(text)
    parsed = F.from_json(guard, f"array<struct<{RECORD_SCHEMA.replace(' string', ':string')}>>")
    return docs.select(F.explode(parsed).alias("r")).select("r.*")


def read_availability_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_availability(parse_documents(spark.read.text(path, wholetext=True)))
