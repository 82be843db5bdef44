"""Reader and sink queries: raw text tables derived from the given data, parsed and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutline.catalog.bindings import NAMES, pick, sql_key, sql_pick, sql_slug
from cutline.catalog.labels import MAN, classified
from cutline.catalog.names import ALIASES, STRICT
from cutline.catalog.registry import Registry
from cutline.operators import aliases as A
from cutline.operators import manifest as MO
from cutline.plans.store import materialize
from cutline.session import checkpoint_dir
from cutline.sources import availability as SA
from cutline.sources import event_files as SE
from cutline.sources import matches as SM
from cutline.sources import quotes as SQ
from cutline.sources import raw as SR_RAW
from cutline.sources import results as SR
from cutline.sources import sinks as SS
from cutline.sources import tournaments as ST

REGISTRY = Registry()
query = REGISTRY.query

WINNERS = ("USA", "Draw", "TBD", "n/a", "Türkiye", "New Town")
BOOLS = ("TRUE", "f", "Yes", "0", "y", "")
WIN_SQL, BOOL_SQL = sql_pick(WINNERS, "match_id % 6"), sql_pick(BOOLS, "match_id % 6")
NAME_SQL = sql_pick(NAMES, "match_id % 20")


def _iso(c="kickoff_at"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def raw_match_text(v):
    """A match file as text columns with odd headers."""
    k = F.col("match_id")
    return v.duels.select(
        k.cast("string").alias("ID"),
        F.when(k % 13 == 1, "").when(k % 13 == 2, "soon").otherwise(_iso()).alias(" Date "),
        F.col("competition_id").alias("Competition"),
        F.col("stage").alias("Round"),
        pick(NAMES, k % 20).alias("HOME"),
        F.col("away_team_id").alias("away_team"),
        F.when(k % 3 == 0, F.concat(F.col("home_goals_90").cast("string"), F.lit(".0"))).otherwise(F.col("home_goals_90").cast("string")).alias("home_score"),
        F.when(k % 8 == 5, "x").otherwise(F.col("away_goals_90").cast("string")).alias("away_goals"),
        pick(WINNERS, k % 6).alias("winner"),
        pick(BOOLS, k % 6).alias("neutral"),
    )


STRICT_NAME = f"""CASE WHEN {{n}} IS NULL OR {{n}} = '' OR lower(trim({{n}})) IN ('draw', 'tbd', 'n/a', 'unknown') THEN NULL
  WHEN {{k}} = '' THEN 'unknown' ELSE coalesce((SELECT team_id FROM reg WHERE alias_key = {{k}}), replace({{k}}, ' ', '_')) END"""


def strict(n: str) -> str:
    return STRICT_NAME.format(n=n, k=sql_key(n))


@query(
    "read_matches",
    f"""WITH {STRICT} SELECT CAST(match_id AS VARCHAR) AS match_id, kickoff_at, competition_id, stage, season_or_year,
      coalesce({strict('nm')}, 'home') AS home_team_id, replace(away_team_id, '_', '_') AS away_team_id, home_goals_90 AS home_goals,
      CASE WHEN match_id % 8 = 5 THEN NULL ELSE away_goals_90 END AS away_goals, {strict('wn')} AS winner_team_id,
      {BOOL_SQL} IN ('TRUE', 'Yes', 'y') AS neutral_venue, 'local' AS source
    FROM (SELECT *, {NAME_SQL} AS nm, {WIN_SQL} AS wn FROM duels WHERE match_id % 13 NOT IN (1, 2))""",
    ("duels",),
)
def read_matches(v):
    good, _ = SM.parse_matches(raw_match_text(v))
    return good.drop("advancing_team_id", "venue_name", "city", "country")


@query(
    "read_matches_quarantine",
    "SELECT CAST(match_id AS VARCHAR) AS match_id, CASE match_id % 13 WHEN 1 THEN 'missing_kickoff' ELSE 'invalid_kickoff' END AS reason FROM duels WHERE match_id % 13 IN (1, 2)",
    ("duels",),
)
def read_matches_quarantine(v):
    return SM.parse_matches(raw_match_text(v))[1].select("match_id", "reason")


def raw_quote_text(v):
    s = F.col("quote_seq")
    return v.quotes.select(
        F.concat(F.lit(" "), F.col("match_id").cast("string")).alias("Match_ID"),
        "bookmaker", "market_type", F.upper("selection").alias("selection"),
        F.when(s % 29 == 3, "n/a").when(s % 29 == 4, "0.95").otherwise(F.round("decimal_odds", 2).cast("string")).alias("decimal_odds"),
        F.when(s % 31 == 7, "?").otherwise(_iso("captured_at")).alias("captured_at"),
        F.when(s % 3 == 0, _iso("captured_at")).alias("published_at"),
        F.when(F.col("is_live"), "True").otherwise("no").alias("is_live"),
        s.cast("string").alias("raw_payload_hash"),
    )


@query(
    "read_odds",
    """SELECT CAST(match_id AS VARCHAR) AS match_id, bookmaker, market_type, lower(selection) AS selection, round(round(decimal_odds, 2), 6) AS decimal_odds, captured_at,
      is_live, CASE WHEN quote_seq % 3 = 0 THEN captured_at END AS published_at, captured_at AS ingested_at, captured_at AS effective_at,
      CAST(quote_seq AS VARCHAR) AS raw_payload_hash, 'local' AS source
    FROM quotes WHERE quote_seq % 29 NOT IN (3, 4) AND quote_seq % 31 <> 7""",
    ("quotes",),
)
def read_odds(v):
    return SQ.parse_odds(raw_quote_text(v))[0].select(
        "match_id", "bookmaker", "market_type", "selection", "decimal_odds", "captured_at", "is_live", "published_at",
        "ingested_at", "effective_at", "raw_payload_hash", "source",
    )


@query(
    "read_odds_quarantine",
    """SELECT CAST(quote_seq AS VARCHAR) AS raw_payload_hash, CASE WHEN quote_seq % 31 = 7 THEN 'invalid_captured_at' WHEN quote_seq % 29 = 3 THEN 'invalid_decimal_odds' ELSE 'odds_not_above_one' END AS reason
    FROM quotes WHERE quote_seq % 29 IN (3, 4) OR quote_seq % 31 = 7""",
    ("quotes",),
)
def read_odds_quarantine(v):
    return SQ.parse_odds(raw_quote_text(v))[1].select("raw_payload_hash", "reason")


@query(
    "read_availability",
    """SELECT CAST(match_id AS VARCHAR) AS match_id, team_id, CASE WHEN record_id % 4 = 0 THEN 'unknown' ELSE role END AS role, availability_status,
      round(CASE WHEN record_id % 5 = 0 THEN 0.5 ELSE confidence END, 6) AS confidence,
      CASE WHEN record_id % 3 = 0 THEN published_at ELSE published_at + INTERVAL 1 HOUR END AS published_at, published_at + INTERVAL 1 HOUR AS observed_at, CAST(record_id AS VARCHAR) AS raw_payload_hash
    FROM availability WHERE record_id % 17 <> 2""",
    ("availability",),
)
def read_availability(v):
    """JSON array documents with missing fields; a bad time is quarantined."""
    r = F.col("record_id")
    later = F.timestamp_seconds(F.unix_seconds("published_at") + 3600)
    rec = F.struct(
        "match_id", "team_id", F.when(r % 4 != 0, F.col("role")).alias("role"), "availability_status",
        F.when(r % 5 != 0, F.col("confidence")).alias("confidence"),
        F.when(r % 3 == 0, _iso("published_at")).alias("published_at"),
        F.when(r % 17 == 2, "yesterday").otherwise(_iso(later)).alias("observed_at"),
        r.cast("string").alias("raw_payload_hash"),
    )
    docs = v.availability.select(F.to_json(F.array(rec)).alias("value"))
    good, _ = SA.parse_availability(SA.parse_documents(docs))
    return good.select(
        "match_id", "team_id", "role", "availability_status", "confidence", "published_at", "observed_at", "raw_payload_hash"
    )


def raw_result_text(v):
    k = F.col("match_id")
    return v.duels.select(
        F.when(k % 19 == 4, "not a date").otherwise(F.date_format("kickoff_at", "yyyy-MM-dd")).alias("date"),
        F.concat(pick(NAMES, k % 20), F.lit(" ")).alias("home"), F.col("away_team_id").alias("Away_Team"),
        F.col("home_goals_90").cast("string").alias("home_score"), F.col("away_goals_90").cast("string").alias("away_score"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Copa América "), F.col("competition_id"))).alias("tournament"),
        pick(BOOLS, k % 6).alias("neutral"), k.alias("ordinal"),
    )


@query(
    "read_results",
    f"""WITH {ALIASES}, t AS (SELECT *, trim({NAME_SQL}) AS nm, strftime(kickoff_at, '%Y-%m-%d') AS d, replace(away_team_id, '_', ' ') AS ak FROM duels),
    u AS (SELECT *, coalesce((SELECT team_id FROM reg WHERE alias_key = {sql_key('nm')}), {sql_slug('nm')}) AS hid FROM t WHERE match_id % 19 <> 4 AND nm <> '')
    SELECT match_id AS ordinal, 'MJ42_' || regexp_replace({sql_key('nm')} || '_' || ak || '_' || d, '[^0-9A-Za-z_\\-]', '_', 'g') AS match_id,
      date_trunc('day', kickoff_at) AS kickoff_at, CASE WHEN match_id % 3 = 0 THEN 'unknown' ELSE 'copa_america_' || replace(replace(lower(competition_id), '-', '_'), ' ', '_') END AS competition_id,
      'unknown' AS stage, season_or_year, hid AS home_team_id, away_team_id, home_goals_90 AS home_goals, away_goals_90 AS away_goals,
      CASE WHEN home_goals_90 > away_goals_90 THEN hid WHEN home_goals_90 < away_goals_90 THEN away_team_id END AS winner_team_id,
      {BOOL_SQL} IN ('TRUE', 'Yes', 'y') AS neutral_venue FROM u""",
    ("duels",),
)
def read_results(v):
    good, _ = SR.parse_results(raw_result_text(v), A.builtin_registry(v.spark))
    return good.withColumn("competition_id", F.replace("competition_id", F.lit(" "), F.lit("_"))).drop(
        "raw_date", "home_team", "away_team", "city", "country", "source"
    )


@query(
    "read_results_quarantine",
    f"""SELECT match_id AS ordinal, CASE WHEN match_id % 19 = 4 THEN 'invalid_date' ELSE 'missing_team' END AS reason FROM duels
    WHERE match_id % 19 = 4 OR coalesce(trim({NAME_SQL}), '') = ''""",
    ("duels",),
)
def read_results_quarantine(v):
    return SR.parse_results(raw_result_text(v), A.builtin_registry(v.spark))[1].select("ordinal", "reason")


# -- tournament documents --------------------------------------------------------------------

def tournament_docs(v):
    """One document per match: even orders in the rounds layout with team objects and flat scores,
    odd ones in the flat layout with team texts and nested scores."""
    k = F.col("match_id")
    h, a = F.col("home_goals_90"), F.col("away_goals_90")
    obj = lambda c: F.struct(F.concat(F.lit(" "), F.col(c)).alias("name"), F.lit("X").alias("code"))
    date = F.date_format("kickoff_at", "yyyy-MM-dd").alias("date")
    name = F.concat(F.lit("Cup "), F.col("season_or_year")).alias("name")
    nested = F.struct(
        F.when(k % 4 == 0, F.concat(F.lit("Key "), k.cast("string"))).alias("key"), date,
        obj("home_team_id").alias("team1"), obj("away_team_id").alias("team2"), h.alias("score1"), a.alias("score2"),
        F.when(k % 3 == 0, h + 1).alias("score1et"), F.when(k % 3 == 0, a).alias("score2et"),
        F.when(k % 10 == 0, F.lit(2)).alias("winner"),
    )
    flat = F.struct(
        F.col("stage").alias("round"), date, F.col("home_team_id").alias("team1"), F.col("away_team_id").alias("team2"),
        F.struct(
            F.when(k % 7 != 1, F.array(h, a)).alias("ft"), F.when(k % 5 == 1, F.array(h, a + 1)).alias("et"),
            F.when(k % 3 == 1, F.array(h + 3, a + 4)).alias("p"),
        ).alias("score"),
        F.when(k % 9 == 1, " 1 ").alias("winner"),
    )
    round_name = F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("stage"))
    rounds = F.array(F.struct(round_name.alias("name"), F.array(nested).alias("matches")))
    return v.duels.select(
        F.when(k % 2 == 0, F.to_json(F.struct(name, rounds.alias("rounds")))).otherwise(
            F.to_json(F.struct(name, F.array(flat).alias("matches")))
        ).alias("value")
    )


TOUR = """tr AS (
  SELECT match_id % 2 = 0 AS n, match_id AS k, 'OF_' || CASE WHEN match_id % 4 = 0 THEN 'key_' || match_id ELSE strftime(kickoff_at, '%Y%m%d') || '_' || home_team_id || '_' || away_team_id END AS match_id,
    date_trunc('day', kickoff_at) AS kickoff_at, 'Cup ' || season_or_year AS tournament, 'cup_' || season_or_year AS competition_id,
    CASE WHEN match_id % 6 = 0 THEN 'unknown' ELSE stage END AS stage, season_or_year, home_team_id, away_team_id,
    CASE WHEN match_id % 2 = 1 AND match_id % 7 = 1 THEN NULL ELSE home_goals_90 END AS home_goals, CASE WHEN match_id % 2 = 1 AND match_id % 7 = 1 THEN NULL ELSE away_goals_90 END AS away_goals,
    CASE WHEN match_id % 2 = 0 AND match_id % 3 = 0 THEN home_goals_90 + 1 WHEN match_id % 2 = 1 AND match_id % 5 = 1 THEN home_goals_90 END AS home_goals_et,
    CASE WHEN match_id % 2 = 0 AND match_id % 3 = 0 THEN away_goals_90 WHEN match_id % 2 = 1 AND match_id % 5 = 1 THEN away_goals_90 + 1 END AS away_goals_et,
    CASE WHEN match_id % 2 = 1 AND match_id % 3 = 1 THEN home_goals_90 + 3 END AS penalties_home, CASE WHEN match_id % 2 = 1 AND match_id % 3 = 1 THEN away_goals_90 + 4 END AS penalties_away,
    CASE WHEN match_id % 10 = 0 THEN '2' WHEN match_id % 2 = 1 AND match_id % 9 = 1 THEN '1' END AS winner FROM duels)"""


def _tournaments(v):
    return ST.parse_tournaments(ST.parse_documents(tournament_docs(v)), A.builtin_registry(v.spark))


@query(
    "read_tournaments",
    f"""WITH {TOUR} SELECT match_id, kickoff_at, tournament, competition_id, stage, season_or_year, home_team_id, away_team_id, home_goals, away_goals,
      CASE WHEN home_goals > away_goals THEN home_team_id WHEN home_goals < away_goals THEN away_team_id END AS winner_team_id, true AS neutral_venue FROM tr""",
    ("duels",),
)
def read_tournaments(v):
    return _tournaments(v)[0].select(
        "match_id", "kickoff_at", "tournament", "competition_id", "stage", "season_or_year", "home_team_id", "away_team_id",
        "home_goals", "away_goals", "winner_team_id", "neutral_venue",
    )


@query(
    "extract_scores",
    f"WITH {TOUR} SELECT match_id, kickoff_at, home_goals, away_goals, home_goals_et, away_goals_et, penalties_home, penalties_away FROM tr",
    ("duels",),
)
def extract_scores(v):
    return _tournaments(v)[0].select(
        "match_id", "kickoff_at", "home_goals", "away_goals", "home_goals_et", "away_goals_et", "penalties_home", "penalties_away"
    )


@query(
    "tournament_labels",
    f"""WITH {TOUR} SELECT match_id, kickoff_at, CASE WHEN home_goals IS NULL OR away_goals IS NULL THEN NULL WHEN winner = '1' THEN true WHEN winner = '2' THEN false
      WHEN home_goals <> away_goals THEN home_goals > away_goals WHEN penalties_home IS NOT NULL THEN CASE WHEN penalties_home <> penalties_away THEN penalties_home > penalties_away END
      WHEN home_goals_et IS NOT NULL AND (home_goals_et <> home_goals OR away_goals_et <> away_goals) AND home_goals_et <> away_goals_et THEN home_goals_et > away_goals_et END AS home_advances FROM tr""",
    ("duels",),
)
def tournament_labels(v):
    return _tournaments(v)[0].select("match_id", "kickoff_at", "home_advances")


@query(
    "tournament_teams",
    "SELECT home_team_id AS team_name FROM duels WHERE match_id % 2 = 0 UNION SELECT away_team_id FROM duels WHERE match_id % 2 = 0",
    ("duels",),
)
def tournament_teams(v):
    return ST.tournament_teams(ST.parse_documents(tournament_docs(v)))


# -- event documents -------------------------------------------------------------------------

def event_docs(v):
    """One array document per event, every ninth broken."""
    body = F.struct(
        F.struct(F.col("type_name").alias("name")).alias("type"),
        F.struct(F.col("team_id").alias("id")).alias("team"),
        F.struct(F.col("play_pattern").alias("name")).alias("play_pattern"),
        F.struct(F.col("xg").cast("string").alias("statsbomb_xg")).alias("shot"),
    )
    text = F.to_json(F.array(body))
    return v.shots.select(
        "match_id", F.when(F.col("event_id") % 9 == 4, F.lit("[{broken")).otherwise(text).alias("value")
    )


@query(
    "read_events",
    """SELECT match_id, type_name, team_id, play_pattern, round(sum(xg), 6) AS xg, count(*) AS n FROM shots WHERE event_id % 9 <> 4 GROUP BY ALL""",
    ("shots",),
)
def read_events(v):
    rows = SE.event_rows(event_docs(v)).filter(F.col("type_name").isNotNull())
    return rows.groupBy("match_id", "type_name", "team_id", "play_pattern").agg(
        F.sum("xg").alias("xg"), F.count(F.lit(1)).alias("n")
    )


@query(
    "read_event_metadata",
    "SELECT match_id, date_trunc('day', kickoff_at) AS match_at, CASE WHEN match_id % 5 = 0 THEN '' ELSE home_team_id END AS home_team_id, away_team_id FROM duels",
    ("duels",),
)
def read_event_metadata(v):
    side = lambda c: F.struct(c.alias("id"))
    docs = v.duels.select("match_id", F.to_json(F.struct(
        F.date_format("kickoff_at", "yyyy-MM-dd").alias("match_date"),
        side(F.when(F.col("match_id") % 5 != 0, F.col("home_team_id"))).alias("home_team"), side(F.col("away_team_id")).alias("away_team"),
    )).alias("value"))
    return SE.meta_rows(docs)


@query(
    "event_listing",
    "SELECT DISTINCT match_id FROM shots WHERE event_id % 9 <> 4",
    ("shots",),
)
def event_listing(v):
    """Matches with at least one readable event document."""
    return SE.event_rows(event_docs(v)).filter(F.col("type_name").isNotNull()).select("match_id").distinct()


# -- sinks -----------------------------------------------------------------------------------

@query(
    "export_query",
    "SELECT competition_id, season_or_year, count(*) AS n, sum(home_goals_90)::BIGINT AS goals FROM duels GROUP BY ALL",
    ("duels",),
)
def export_query(v):
    """SQL result written as Parquet and read back."""
    view, path = f"duels_{uuid.uuid4().hex}", f"{checkpoint_dir(v.spark)}/export-{uuid.uuid4().hex}"
    v.duels.createOrReplaceTempView(view)
    SS.export_query(v.spark, f"SELECT competition_id, season_or_year, count(*) AS n, sum(home_goals_90) AS goals FROM {view} GROUP BY 1, 2", path)
    v.spark.catalog.dropTempView(view)
    return v.spark.read.parquet(path)


@query("synthetic_matches")
def synthetic_matches(v):
    """Hashed matches, one per order."""
    return SS.synthetic_matches(v.table("orders").select(F.col("o_orderkey").alias("id")))


@query(
    "write_report",
    """SELECT fold, count(*) AS n, round(avg(home_advances), 6) AS rate, count(*) AS csv_rows, count(*) AS parquet_rows, (SELECT count(*) FROM scored) AS total
    FROM scored GROUP BY fold""",
    ("scored",),
)
def write_report(v):
    """The report of a run written in all its formats and read back: per-fold JSON, next to the rows in CSV and Parquet."""
    path = f"{checkpoint_dir(v.spark)}/report-{uuid.uuid4().hex}"
    cols = ["fold", "match_id", "home_advance_probability", "home_advances"]
    rows = v.scored.select(*cols)
    folds = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("home_advances").alias("rate"))
    SS.write_report(path, rows, folds, rows.agg(F.count(F.lit(1)).alias("total")))
    count = lambda df, name: df.groupBy("fold").agg(F.count(F.lit(1)).alias(name))
    written = v.spark.read.option("header", True).csv(f"{path}/predictions_csv")
    total = v.spark.read.schema("total long").json(f"{path}/summary_json").first()[0]
    return (
        v.spark.read.schema("fold string, n long, rate double").json(f"{path}/folds_json")
        .join(count(written, "csv_rows"), "fold").join(count(v.spark.read.parquet(f"{path}/predictions_parquet"), "parquet_rows"), "fold")
        .withColumn("total", F.lit(total).cast("long"))
    )


@query(
    "write_manifest",
    f"""WITH {MAN} SELECT 'manifest' AS artifact, source AS name, count(*) AS n FROM man GROUP BY 2
    UNION ALL SELECT 'excluded', reason, count(*) FROM cl WHERE reason IS NOT NULL GROUP BY 2""",
    ("duels",),
)
def write_manifest(v):
    """The manifest's artifacts written as JSON tables and read back."""
    path = f"{checkpoint_dir(v.spark)}/manifest-{uuid.uuid4().hex}"
    rows = materialize(classified(v), "classified")
    SS.write_manifest(path, {"manifest": MO.accepted(rows), "quarantine": MO.excluded(rows), "third_place": MO.excluded(rows, third_place=True)})
    read = lambda name, col: v.spark.read.schema(f"{col} string").json(f"{path}/{name}").select(F.col(col).alias("name"))
    parts = read("manifest", "source").withColumn("artifact", F.lit("manifest")).unionByName(
        read("quarantine", "reason").unionByName(read("third_place", "reason")).withColumn("artifact", F.lit("excluded"))
    )
    return parts.groupBy("artifact", "name").agg(F.count(F.lit(1)).alias("n"))


CHECKED = {"orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_nothing", "l_absent"), "events": ("event_id", "user_id", "missing_key")}


@query(
    "check_schema",
    """SELECT 'orders' AS source, '' AS problem, count(*) AS n FROM orders UNION ALL
    SELECT 'lineitem', 'missing columns: l_absent, l_nothing', count(*) FROM lineitem UNION ALL
    SELECT 'events', 'missing columns: missing_key', count(*) FROM events""",
)
def check_schema(v):
    """Required columns of whole tables: what is missing, and the rows concerned."""
    out = None
    for name, wanted in CHECKED.items():
        df, problem = v.table(name), ""
        try:
            SR_RAW.check_schema(df, list(wanted))
        except ValueError as missing:
            problem = str(missing)
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), F.lit(problem).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out
