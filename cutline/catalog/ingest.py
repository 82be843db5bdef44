"""Table-maintenance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.operators import aliases as A
from cutline.operators import ingest as I
from cutline.plans.snapshots import extend_snapshots
from cutline.plans.upsert import read_parts, upsert_parts
from cutline.session import checkpoint_dir
from cutline.streaming.keyed import append_stream

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "insert_teams_if_absent",
    """SELECT team_id, arg_min(canonical_name, ord) AS canonical_name FROM (
      SELECT home_team_id AS team_id, 'seen at ' || match_id AS canonical_name, match_id AS ord FROM duels)
    WHERE team_id NOT IN (SELECT DISTINCT home_team_id FROM duels WHERE competition_id = '1-URGENT') GROUP BY team_id""",
    ("duels",),
)
def insert_teams_if_absent(v):
    stored = A.distinct_teams(v.duels.filter(F.col("competition_id") == "1-URGENT"), "home_team_id", "home_team_id")
    batch = v.duels.select(
        F.col("home_team_id").alias("team_id"), F.concat(F.lit("seen at "), F.col("match_id").cast("string")).alias("canonical_name"),
        F.col("match_id").alias("ord"),
    )
    return I.insert_if_absent(stored, batch, ["team_id"], ["ord"]).select("team_id", "canonical_name")


@query(
    "get_or_create_competition",
    """SELECT competition_id, 1.0::DOUBLE AS importance_weight FROM duels WHERE competition_id NOT IN (SELECT competition_id FROM competitions) GROUP BY 1
    UNION ALL SELECT competition_id, round(importance_weight, 6) FROM competitions""",
    ("duels", "competitions"),
)
def get_or_create_competition(v):
    stored = v.competitions
    batch = v.duels.select("competition_id", F.lit(1.0).alias("importance_weight"))
    return stored.unionByName(I.insert_if_absent(stored, batch, ["competition_id"], ["importance_weight"]))


UPS = """stored AS (SELECT match_id, kickoff_at, home_team_id, away_team_id, stage, home_goals_90 FROM duels WHERE match_id % 2 = 0),
batch AS (
  SELECT match_id, kickoff_at + to_hours(CAST(n + 1 AS BIGINT)) AS kickoff_at, away_team_id AS home_team_id, home_team_id AS away_team_id,
    stage || ' v' || n AS stage, home_goals_90 + n AS home_goals_90, match_id * 2 + n AS ord FROM duels, (VALUES (0), (1)) t(n) WHERE match_id % 3 <> 0)"""


def _batch(v):
    n = F.col("n")
    d = v.duels.filter(F.col("match_id") % 3 != 0).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    return d.select(
        "match_id", F.timestamp_seconds(F.unix_seconds("kickoff_at") + (n + 1) * 3600).alias("kickoff_at"),
        F.col("away_team_id").alias("home_team_id"), F.col("home_team_id").alias("away_team_id"),
        F.concat("stage", F.lit(" v"), n.cast("string")).alias("stage"), (F.col("home_goals_90") + n).alias("home_goals_90"),
        (F.col("match_id") * 2 + n).alias("ord"),
    )


@query(
    "upsert_matches",
    f"""WITH {UPS}, f AS (SELECT match_id, arg_min((kickoff_at, home_team_id, away_team_id), ord) AS f, arg_max((stage, home_goals_90), ord) AS m FROM batch GROUP BY 1)
    SELECT match_id, coalesce(s.kickoff_at, f.f[1]) AS kickoff_at, coalesce(s.home_team_id, f.f[2]) AS home_team_id, coalesce(s.away_team_id, f.f[3]) AS away_team_id,
      CASE WHEN f.m IS NULL THEN s.stage ELSE f.m[1] END AS stage, CASE WHEN f.m IS NULL THEN s.home_goals_90 ELSE f.m[2] END AS home_goals_90, s.kickoff_at IS NULL AS inserted
    FROM stored s FULL JOIN f USING (match_id)""",
    ("duels",),
)
def upsert_matches(v):
    stored = v.duels.filter(F.col("match_id") % 2 == 0).select(
        "match_id", "kickoff_at", "home_team_id", "away_team_id", "stage", "home_goals_90"
    )
    return I.upsert_matches(stored, _batch(v), ["ord"])


@query(
    "upsert_matches_parts",
    f"""WITH {UPS}, f AS (SELECT match_id, arg_min((kickoff_at, home_team_id, away_team_id), ord) AS f, arg_max((stage, home_goals_90), ord) AS m FROM batch GROUP BY 1)
    SELECT match_id, coalesce(s.kickoff_at, f.f[1]) AS kickoff_at, coalesce(s.home_team_id, f.f[2]) AS home_team_id, coalesce(s.away_team_id, f.f[3]) AS away_team_id,
      CASE WHEN f.m IS NULL THEN s.stage ELSE f.m[1] END AS stage, CASE WHEN f.m IS NULL THEN s.home_goals_90 ELSE f.m[2] END AS home_goals_90
    FROM stored s FULL JOIN f USING (match_id)""",
    ("duels",),
)
def upsert_matches_parts(v):
    """The same upsert on a stored table: once to fill it, once to bring the batch in."""
    stored = v.duels.filter(F.col("match_id") % 2 == 0).select(
        "match_id", "kickoff_at", "home_team_id", "away_team_id", "stage", "home_goals_90"
    )
    path = f"{checkpoint_dir(v.spark)}/matches-{uuid.uuid4().hex}"
    merge = lambda table, batch: I.upsert_matches(table, batch, ["ord"])
    for batch in (stored.withColumn("ord", F.col("match_id")), _batch(v)):
        upsert_parts(path, batch, merge, stored.schema, parts=16)
    return read_parts(v.spark, path, stored.schema, 16)


@query(
    "upsert_results",
    """WITH batch AS (SELECT match_id, NOT home_advances AS home_advances, match_id * 2 + n AS ord, n FROM results, (VALUES (0), (1)) t(n) WHERE match_id % 3 <> 0)
    SELECT match_id, home_advances FROM results WHERE match_id % 2 = 0 AND match_id NOT IN (SELECT match_id FROM batch)
    UNION ALL SELECT match_id, arg_max(CASE WHEN n = 1 THEN home_advances ELSE NOT home_advances END, ord) FROM batch GROUP BY 1""",
    ("results",),
)
def upsert_results(v):
    r = v.results.select("match_id", "home_advances")
    n = F.col("n")
    batch = r.filter(F.col("match_id") % 3 != 0).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "match_id", F.when(n == 1, ~F.col("home_advances")).otherwise(F.col("home_advances")).alias("home_advances"),
        (F.col("match_id") * 2 + n).alias("ord"),
    )
    return I.upsert_results(r.filter(F.col("match_id") % 2 == 0), batch, ["ord"])


HASHED = "SELECT match_id, bookmaker, decimal_odds, quote_seq, bookmaker || '/' || match_id || '/' || selection AS raw_payload_hash, captured_at FROM quotes"


def _hashed(v):
    return v.quotes.select(
        "match_id", "bookmaker", "decimal_odds", "quote_seq",
        F.concat_ws("/", "bookmaker", F.col("match_id").cast("string"), "selection").alias("raw_payload_hash"), "captured_at",
    )


@query(
    "append_odds_dedup",
    f"""WITH q AS ({HASHED}) SELECT raw_payload_hash, arg_min(match_id, (quote_seq, captured_at, decimal_odds)) AS match_id,
      round(arg_min(decimal_odds, (quote_seq, captured_at, decimal_odds)), 6) AS decimal_odds
    FROM q WHERE captured_at >= TIMESTAMP '1998-01-01' AND raw_payload_hash NOT IN (SELECT raw_payload_hash FROM q WHERE captured_at < TIMESTAMP '1998-01-01') GROUP BY 1""",
    ("quotes",),
)
def append_odds_dedup(v):
    q, cut = _hashed(v), F.to_timestamp(F.lit("1998-01-01"))
    stored, batch = q.filter(F.col("captured_at") < cut), q.filter(F.col("captured_at") >= cut)
    return I.append_new(stored, batch, order=["quote_seq", "captured_at", "decimal_odds"]).select(
        "raw_payload_hash", "match_id", "decimal_odds"
    )


@query("append_odds_stream", f"SELECT DISTINCT raw_payload_hash, match_id FROM ({HASHED})", ("quotes",))
def append_odds_stream(v):
    """All quotes as a stream, their hashes known from state."""
    base = f"{checkpoint_dir(v.spark)}/quotes-{uuid.uuid4().hex}"
    quotes = _hashed(v).select("raw_payload_hash", "match_id")
    quotes.write.parquet(f"{base}/in")
    fresh = append_stream(v.spark.readStream.schema(quotes.schema).parquet(f"{base}/in"))
    sink = fresh.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    run = sink.trigger(availableNow=True).start()
    run.awaitTermination()
    return v.spark.read.schema(quotes.schema).parquet(f"{base}/out")


@query(
    "append_availability_dedup",
    """WITH a AS (SELECT *, team_id || '/' || role || '/' || (match_id // 20) AS h FROM availability)
    SELECT h AS raw_payload_hash, min(record_id) AS record_id FROM a WHERE published_at >= TIMESTAMP '1998-01-01'
      AND h NOT IN (SELECT h FROM a WHERE published_at < TIMESTAMP '1998-01-01') GROUP BY 1""",
    ("availability",),
)
def append_availability_dedup(v):
    a = v.availability.withColumn(
        "raw_payload_hash", F.concat_ws("/", "team_id", "role", F.floor(F.col("match_id") / 20).cast("string"))
    )
    cut = F.to_timestamp(F.lit("1998-01-01"))
    fresh = I.append_new(a.filter(F.col("published_at") < cut), a.filter(F.col("published_at") >= cut), order=["record_id"])
    return fresh.select("raw_payload_hash", "record_id")


@query(
    "validate_odds",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 > 1 AS ok, CASE WHEN l_quantity / 10 > 1 THEN 0 ELSE 1 END AS n_reasons FROM lineitem""",
)
def validate_odds(v):
    q = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10).alias("decimal_odds"),
        F.col("l_shipdate").cast("timestamp").alias("captured_at"), F.col("l_partkey").alias("match_id"),
    )
    good, bad = I.validate_odds(q)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return good.select(*keys, F.lit(True).alias("ok"), F.lit(0).alias("n_reasons")).unionByName(
        bad.select(*keys, F.lit(False).alias("ok"), F.size("reasons").alias("n_reasons"))
    )


@query(
    "validate_availability",
    "SELECT record_id, confidence * 1.2 - 0.1 BETWEEN 0 AND 1 AS ok FROM availability",
    ("availability",),
)
def validate_availability(v):
    good, bad = I.validate_availability(v.availability.withColumn("confidence", F.col("confidence") * 1.2 - 0.1))
    return good.select("record_id", F.lit(True).alias("ok")).unionByName(bad.select("record_id", F.lit(False).alias("ok")))


@query("validate_results", "SELECT match_id, home_advances IS NOT NULL AS ok FROM duels", ("duels",))
def validate_results(v):
    good, bad = I.validate_results(v.duels)
    return good.select("match_id", F.lit(True).alias("ok")).unionByName(bad.select("match_id", F.lit(False).alias("ok")))


@query(
    "stable_hash",
    """SELECT count(*) AS n, count(DISTINCT (match_id, bookmaker, selection, captured_at)) AS n_hashes, true AS order_free FROM quotes""",
    ("quotes",),
)
def stable_hash(v):
    """Hashes tell rows apart and do not depend on column order."""
    from cutline.functions.hashing import stable_hash as h

    cols = ["match_id", "bookmaker", "selection", "captured_at"]
    both = v.quotes.select(h(cols).alias("a"), h(cols[::-1]).alias("b"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("n_hashes"), F.bool_and(F.col("a") == F.col("b")).alias("order_free")
    )


@query(
    "missing_snapshots",
    "SELECT match_id, cutoff_time, 'v1' AS feature_version FROM spine WHERE stage <> 'Final'",
    ("spine",),
)
def missing_snapshots(v):
    asked = v.spine.withColumn("feature_version", F.lit("v1"))
    return I.missing_snapshots(asked, asked.filter(F.col("stage") == "Final"))


@query(
    "extend_snapshots",
    """SELECT match_id, cutoff_time, 'v1' AS feature_version, '{"days":' || date_diff('day', DATE '1990-01-01', CAST(cutoff_time AS DATE)) || '}' AS features_json FROM spine""",
    ("spine",),
)
def extend_snapshots_twice(v):
    """A stored table of snapshots: finals first, then all, of which only the others are built."""
    path = f"{checkpoint_dir(v.spark)}/snapshots-{uuid.uuid4().hex}"

    def build(spine):
        days = F.date_diff(F.to_date("cutoff_time"), F.lit("1990-01-01").cast("date"))
        return spine.withColumns({"days": days, "source_data_max_timestamp": F.col("cutoff_time")})

    asked = v.spine.select("match_id", "cutoff_time", "stage")
    extend_snapshots(path, asked.where(F.col("stage") == "Final"), build, "v1", ["days"])
    return extend_snapshots(path, asked, build, "v1", ["days"]).select("match_id", "cutoff_time", "feature_version", "features_json")
