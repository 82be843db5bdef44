"""Availability and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.functions.rules import AVAILABILITY_STATUSES
from cutline.operators import events as O
from cutline.operators import lineup as L
from cutline.operators.features import team_cutoffs
from cutline.sources import event_files as J

REGISTRY = Registry()
query = REGISTRY.query

COUNTS = ", ".join(
    [f"CAST(count(*) FILTER (availability_status = '{s}') AS DOUBLE) AS availability_count_{s}" for s in AVAILABILITY_STATUSES]
    + [
        f"CAST(count(*) FILTER (availability_status IN ('confirmed_out', 'suspended') AND lower(role) LIKE '%{b}%') AS DOUBLE) AS confirmed_out_{b}s"
        for b in ("goalkeeper", "defender", "midfielder", "attacker")
    ]
    + ["CAST(count(*) FILTER (availability_status = 'lineup_confirmed') > 0 AS DOUBLE) AS lineup_confirmed"]
)
LINEUP = f"""seen AS (
  SELECT a.*, s.cutoff_time FROM availability a JOIN spine s USING (match_id) WHERE published_at <= cutoff_time),
counts AS (SELECT match_id, cutoff_time, team_id, {COUNTS} FROM seen GROUP BY ALL)"""
DIFFS = ", ".join(f"coalesce(h.{c}, 0) - coalesce(a.{c}, 0) AS {c}_diff" for c in L.LINEUP_COLUMNS)


@query(
    "availability_before",
    "SELECT a.match_id, record_id, team_id, availability_status, published_at, cutoff_time FROM availability a JOIN spine s USING (match_id) WHERE published_at <= cutoff_time",
    ("availability", "spine"),
)
def availability_before(v):
    return L.availability_before(v.availability, v.spine).select(
        "match_id", "record_id", "team_id", "availability_status", "published_at", "cutoff_time"
    )


@query("lineup_counts", f"WITH {LINEUP} SELECT * FROM counts", ("availability", "spine"))
def lineup_counts(v):
    return L.lineup_counts(L.availability_before(v.availability, v.spine), ["match_id", "cutoff_time", "team_id"])


@query(
    "lineup_diff",
    f"""WITH {LINEUP} SELECT s.match_id, {DIFFS} FROM spine s
    LEFT JOIN counts h ON h.match_id = s.match_id AND h.cutoff_time = s.cutoff_time AND h.team_id = s.home_team_id
    LEFT JOIN counts a ON a.match_id = s.match_id AND a.cutoff_time = s.cutoff_time AND a.team_id = s.away_team_id""",
    ("availability", "spine"),
)
def lineup_diff(v):
    counts = L.lineup_counts(L.availability_before(v.availability, v.spine), ["match_id", "cutoff_time", "team_id"])
    sides = v.spine.select("match_id", "cutoff_time", "home_team_id", "away_team_id")
    return L.lineup_diff(sides, counts).select("match_id", *[f"{c}_diff" for c in L.LINEUP_COLUMNS])


SUMMARY = """SELECT match_id, CAST(count(*) AS DOUBLE) AS events_count, CAST(count(*) FILTER (type_name = 'Shot') AS DOUBLE) AS shots_count,
  round(coalesce(sum(xg) FILTER (type_name = 'Shot'), 0), 6) AS xg_total,
  round(coalesce(sum(xg) FILTER (type_name = 'Shot' AND play_pattern IN ('From Free Kick', 'From Corner')), 0), 6) AS set_piece_xg
FROM shots GROUP BY ALL"""


@query("summarize_events", SUMMARY, ("shots",))
def summarize_events(v):
    return O.summarize_events(v.shots)


@query("summarize_event_documents", SUMMARY, ("shots",))
def summarize_event_documents(v):
    """The same summary from nested JSON records, one document per event batch."""
    body = F.struct(
        F.struct(F.col("type_name").alias("name")).alias("type"),
        F.struct(F.col("team_id").alias("id")).alias("team"),
        F.struct(F.col("play_pattern").alias("name")).alias("play_pattern"),
        F.struct(F.col("xg").alias("statsbomb_xg")).alias("shot"),
    )
    docs = v.shots.select(
        F.to_json(F.struct(F.col("match_id"), F.array(body).alias("events"))).alias("value")
    )
    rows = J.record_events(docs).withColumn("match_id", F.col("match_id").cast("bigint"))
    return O.summarize_events(rows)


TEAM = """per AS (
  SELECT match_id, team_id, sum(xg) AS xg, CAST(count(*) AS DOUBLE) AS shots,
    CAST(count(*) FILTER (sp) AS DOUBLE) AS box, coalesce(sum(xg) FILTER (sp), 0) AS spxg
  FROM (SELECT *, play_pattern IN ('From Free Kick', 'From Corner') AS sp FROM shots WHERE type_name = 'Shot' AND team_id IS NOT NULL) GROUP BY ALL)"""


@query(
    "event_match_features",
    f"""WITH {TEAM} SELECT m.match_id, round(coalesce(h.xg, 0), 4) AS xg_home, round(coalesce(a.xg, 0), 4) AS xg_away,
      coalesce(h.shots, 0) AS shots_home, coalesce(a.shots, 0) AS shots_away,
      coalesce(h.box, 0) AS shots_in_box_home, coalesce(a.box, 0) AS shots_in_box_away,
      round(coalesce(h.spxg, 0), 4) AS set_piece_xg_home, round(coalesce(a.spxg, 0), 4) AS set_piece_xg_away,
      CAST(m.match_id IN (SELECT match_id FROM shots) AS DOUBLE) AS events_available
    FROM shot_meta m LEFT JOIN per h ON h.match_id = m.match_id AND h.team_id = m.home_team_id
    LEFT JOIN per a ON a.match_id = m.match_id AND a.team_id = m.away_team_id""",
    ("shots", "shot_meta"),
)
def event_match_features(v):
    return O.event_match_features(v.shots, v.shot_meta.drop("match_at")).drop(
        "xg_difference", "set_piece_shots_home", "set_piece_shots_away"
    )


TOTALS = TEAM + """,
hist AS (
  SELECT m.match_at, m.team_id, coalesce(xg, 0) AS xg, coalesce(shots, 0) AS shots, coalesce(box, 0) AS box, coalesce(spxg, 0) AS spxg
  FROM (SELECT match_id, match_at, home_team_id AS team_id FROM shot_meta UNION ALL SELECT match_id, match_at, away_team_id FROM shot_meta) m
  LEFT JOIN per USING (match_id, team_id) WHERE m.match_id IN (SELECT match_id FROM shots))"""


@query(
    "event_team_totals",
    f"""WITH {TOTALS} SELECT c.team_id, c.cutoff_time, round(sum(xg), 4) AS xg_total, sum(shots) AS shots_total, sum(box) AS shots_in_box_total,
      round(sum(spxg), 4) AS set_piece_xg_total, CASE WHEN count(h.team_id) > 0 THEN CAST(count(h.team_id) AS DOUBLE) END AS matches_used,
      CAST(count(h.team_id) > 0 AS DOUBLE) AS events_available
    FROM team_cutoffs c LEFT JOIN hist h ON h.team_id = c.team_id AND h.match_at < c.cutoff_time GROUP BY ALL""",
    ("shots", "shot_meta", "team_cutoffs"),
)
def event_team_totals(v):
    return O.event_team_totals(v.shots, v.shot_meta, team_cutoffs(v.spine))


@query(
    "event_coverage",
    """SELECT coalesce(m.match_id, f.match_id) AS match_id, m.match_id IS NOT NULL AS match_metadata, f.match_id IS NOT NULL AS events,
      m.match_id IS NOT NULL AND f.match_id IS NOT NULL AND home <> '' AS home_features,
      m.match_id IS NOT NULL AND f.match_id IS NOT NULL AS away_features
    FROM (SELECT match_id, CASE WHEN match_id % 7 = 0 THEN '' ELSE home_team_id END AS home FROM duels WHERE match_id % 5 <> 0) m
    FULL JOIN (SELECT DISTINCT match_id FROM shots) f ON f.match_id = m.match_id""",
    ("duels", "shots"),
)
def event_coverage(v):
    meta = v.duels.filter(F.col("match_id") % 5 != 0).select(
        "match_id", F.when(F.col("match_id") % 7 == 0, "").otherwise(F.col("home_team_id")).alias("home_team_id"), "away_team_id"
    )
    return O.event_coverage(meta, v.shots)
