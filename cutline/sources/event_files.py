"""Event documents: ``matches/<competition>/<season>/<id>.json`` and ``events/<id>.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.timeutil import to_utc

_EVENT = (
    "struct<`type`:struct<`name`:string>,`team`:struct<`id`:string>,"
    "`play_pattern`:struct<`name`:string>,`shot`:struct<`statsbomb_xg`:string>>"
)
EVENTS_SCHEMA = f"array<{_EVENT}>"
META_SCHEMA = "`match_date` string, `home_team` struct<`id`:string>, `away_team` struct<`id`:string>"
RECORD_SCHEMA = f"`match_id` string, `events` array<{_EVENT}>"


def _listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole documents with the match id taken from the file name."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return df.select(F.regexp_extract("_metadata.file_path", pattern, 1).alias("match_id"), "value")


def event_rows(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(match_id, type_name, team_id, xg, play_pattern); a broken document yields nothing."""
    parsed = docs.select("match_id", F.explode(F.from_json(F.col(doc), EVENTS_SCHEMA)).alias("e"))
    return flatten_events(parsed)


def flatten_events(df: DataFrame) -> DataFrame:
    return df.select(
        "match_id",
        F.col("e.type.name").alias("type_name"),
        F.col("e.team.id").alias("team_id"),
        F.col("e.shot.statsbomb_xg").try_cast("double").alias("xg"),
        F.col("e.play_pattern.name").alias("play_pattern"),
    )


def meta_rows(docs: DataFrame, doc: str = "value") -> DataFrame:
    """(match_id, match_at, home_team_id, away_team_id); an unreadable document is left out."""
    parsed = docs.select("match_id", F.from_json(F.col(doc), META_SCHEMA).alias("m"))
    return parsed.filter(F.col("m").isNotNull()).select(
        "match_id",
        to_utc("m.match_date").alias("match_at"),
        F.coalesce("m.home_team.id", F.lit("")).alias("home_team_id"),
        F.coalesce("m.away_team.id", F.lit("")).alias("away_team_id"),
    )


def readable_listing(docs: DataFrame, doc: str = "value") -> DataFrame:
    """Matches whose event document parses as a list."""
    return docs.filter(F.from_json(F.col(doc), EVENTS_SCHEMA).isNotNull()).select("match_id").distinct()


def read_events(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(meta, events) tables of a data root."""
    meta = meta_rows(_listing(spark, f"{root}/matches", r"([^/]+)\.json$"))
    events = event_rows(_listing(spark, f"{root}/events", r"([^/]+)\.json$"))
    return meta, events


def record_events(records: DataFrame, doc: str = "value") -> DataFrame:
    """The simpler one-document format {match_id, events[]}."""
    parsed = records.select(F.from_json(F.col(doc), RECORD_SCHEMA).alias("r"))
    return flatten_events(parsed.select(F.col("r.match_id").alias("match_id"), F.explode("r.events").alias("e")))
