"""Domain tables derived from the given Parquet tables, once as DataFrames and once as SQL.

The given tables hold no matches; these views map orders to matches, line items to quotes and
events to availability and shots, so that every operator runs on whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = (
    "Group A", "Round of 16", "Quarter-finals", "Semi-finals", "Final", "Match for third place",
    "R16", "QF", "Third-place final", "Matchday 3", "Play-off round", "Round-of-16",
)
NAMES = (
    "  USA ", "u.s.a.", "Côte d’Ivoire", "Cote d'Ivoire", "Türkiye", "Korea, South",
    "korea--republic", "Bosnia & Herzegovina", "Trinidad_and_Tobago", "São Tomé", "Åland  Islands",
    "Curaçao", "Unknown FC", "", None, "North Macedonia", "united_states", "Holland",
    "West-Germany", "!!!",
)
MARKETS = ("home_to_advance", "away_to_advance", "moneyline_90", "draw_90")
STATUSES = (
    "available", "questionable", "doubtful", "suspended", "confirmed_out", "lineup_confirmed", "unknown",
)
ROLES = ("goalkeeper", "Central Defender", "midfielder", "attacker", "coach")
PATTERNS = ("Regular Play", "From Corner", "From Free Kick", "From Counter")
SPREAD = 80  # stretches 30 days of events over the years of the orders


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


def sql_pick(values: tuple, index: str) -> str:
    items = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values)
    return f"([{items}])[CAST({index} AS BIGINT) + 1]"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def duels(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        pool = F.substring("o_orderpriority", 1, 1)
        team = lambda n: F.concat(F.lit("t"), pool, F.lit("_"), F.lpad(n.cast("string"), 2, "0"))
        scored = k % 97 != 13
        hg = F.when(scored, (k % 5).cast("int"))
        ag = F.when(scored, (F.floor("o_totalprice") % 4).cast("int"))
        flip = c % 2 == 0
        adv = (
            F.when(hg > ag, True).when(hg < ag, False)
            .when(scored & (k % 12).isin(0, 9), F.lit(None).cast("boolean"))
            .otherwise(flip)
        )
        return self.table("orders").select(
            k.alias("match_id"),
            F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400).alias("kickoff_at"),
            F.col("o_orderpriority").alias("competition_id"),
            pick(STAGES, k % 12).alias("stage"),
            F.year("o_orderdate").cast("string").alias("season_or_year"),
            team(c % 25).alias("home_team_id"),
            team((c + 1 + k % 24) % 25).alias("away_team_id"),
            hg.alias("home_goals_90"),
            ag.alias("away_goals_90"),
            adv.alias("home_advances"),
            (F.col("o_orderstatus") == "F").alias("neutral_venue"),
        )

    @cached_property
    def results(self) -> DataFrame:
        return self.duels.filter(F.col("home_advances").isNotNull())

    @cached_property
    def spine(self) -> DataFrame:
        return self.duels.withColumn("cutoff_time", F.col("kickoff_at") - F.expr("INTERVAL '24' HOUR"))

    @cached_property
    def competitions(self) -> DataFrame:
        p = F.col("o_orderpriority")
        return self.table("orders").filter(~F.startswith(p, F.lit("4"))).select(
            p.alias("competition_id"),
            (0.5 + F.substring(p, 1, 1).cast("int") * 0.5).cast("double").alias("importance_weight"),
        ).distinct()

    @cached_property
    def quotes(self) -> DataFrame:
        ln = F.col("l_linenumber")
        return self.table("lineitem").select(
            F.col("l_partkey").alias("match_id"),
            F.concat(F.lit("book_"), (F.col("l_suppkey") % 5).cast("string")).alias("bookmaker"),
            pick(MARKETS, F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).when(F.col("l_orderkey") % 16 == 0, 1).when(F.col("l_orderkey") % 16 == 1, 3).otherwise(0)).alias("market_type"),
            F.when(ln == 7, "Draw").when(ln % 2 == 1, "Home").otherwise("away_to_advance").alias("selection"),
            (1.01 + F.col("l_quantity") / 10).alias("decimal_odds"),
            F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + ln * 3600).alias("captured_at"),
            ((F.col("l_linestatus") == "O") & (ln == 4)).alias("is_live"),
            (F.col("l_orderkey") * 10 + ln).alias("quote_seq"),
        )

    @cached_property
    def cutoffs(self) -> DataFrame:
        """One fixed cut-off for every quoted match."""
        return self.table("lineitem").select(F.col("l_partkey").alias("match_id")).distinct().withColumn(
            "cutoff_time", F.to_timestamp(F.lit("2000-01-01 00:00:00"))
        )

    @cached_property
    def availability(self) -> DataFrame:
        e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
        start = F.unix_seconds(F.to_timestamp(F.lit("1995-01-01 00:00:00")))
        offset = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
        base = self.table("events").select(
            F.floor(e / 4).cast("long").alias("match_id"),
            e.alias("record_id"),
            (e % 2).alias("side"),
            pick(STATUSES, k % 7).alias("availability_status"),
            pick(ROLES, F.floor(k / 7) % 5).alias("role"),
            (k / 100.0).alias("confidence"),
            F.timestamp_seconds(start + offset * SPREAD).alias("published_at"),
        )
        sides = self.duels.select("match_id", "home_team_id", "away_team_id")
        return base.join(sides, "match_id").select(
            "match_id", "record_id",
            F.when(F.col("side") == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
            "availability_status", "role", "confidence", "published_at",
        )

    @cached_property
    def shots(self) -> DataFrame:
        """Event rows of the first matches; twenty events each."""
        e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
        base = self.table("events").select(
            F.floor(e / 20).cast("long").alias("match_id"),
            e.alias("event_id"),
            F.when(F.col("event_type") == "purchase", "Shot").otherwise(F.initcap("event_type")).alias("type_name"),
            (k % 3).alias("side"),
            (F.floor("value") / 1000.0).alias("xg"),
            pick(PATTERNS, F.floor(k / 3) % 4).alias("play_pattern"),
        )
        sides = self.duels.select("match_id", "home_team_id", "away_team_id")
        team = F.when(F.col("side") == 0, F.col("home_team_id")).when(F.col("side") == 1, F.col("away_team_id"))
        return base.join(sides, "match_id").select(
            "match_id", "event_id", "type_name", team.alias("team_id"), "xg", "play_pattern"
        )

    @cached_property
    def shot_meta(self) -> DataFrame:
        return self.duels.select("match_id", F.col("kickoff_at").alias("match_at"), "home_team_id", "away_team_id")

    @cached_property
    def raw_names(self) -> DataFrame:
        c = F.col("c_custkey")
        base = pick(NAMES, c % 20)
        return self.table("customer").select(
            c.alias("row_id"),
            F.when((c % 3 == 2) & (c % 20 < 13), F.concat(base, F.lit(" "), (c % 97).cast("string"))).otherwise(base).alias("raw_name"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        v = F.round(F.col("o_totalprice") * 100).cast("long") % 1000
        k = F.col("o_orderkey")
        unit = lambda x: (x % 1000 + 0.5) / 1000.0
        o = self.table("orders").select(
            k.alias("match_id"),
            unit(v).alias("home_advance_probability"),
            F.when(k % 7 != 0, unit(v * 7)).alias("market_probability"),
            F.when(k % 11 != 0, unit(v * 3)).alias("elo_probability"),
        )
        return o.join(
            self.results.select(
                "match_id", F.concat(F.lit("fold_"), F.col("season_or_year")).alias("fold"), "kickoff_at",
                "home_team_id", "away_team_id", F.col("home_advances").cast("int").alias("home_advances"),
            ),
            "match_id",
        )

    @cached_property
    def doc_scored(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "source", "n_chars")
        return self.table("labels").join(d, "doc_id").select(
            "doc_id", F.col("source").alias("fold"), F.col("quality").alias("y"),
            (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"),
        )


_K = "o_orderkey"
_HG = f"(CASE WHEN {_K} % 97 <> 13 THEN CAST({_K} % 5 AS INTEGER) END)"
_AG = f"(CASE WHEN {_K} % 97 <> 13 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 4 AS INTEGER) END)"
_TEAM = "'t' || substr(o_orderpriority, 1, 1) || '_' || lpad(CAST({0} AS VARCHAR), 2, '0')"
_PUB = f"TIMESTAMP '1995-01-01' + to_seconds(CAST(floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) * {SPREAD})"
_JK = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_V = "(CAST(round(o_totalprice * 100) AS BIGINT) % 1000)"


def sql_key(c: str) -> str:
    """Canonical name key in DuckDB."""
    a = f"strip_accents(lower(trim({c})))"
    return f"trim(regexp_replace(regexp_replace({a}, '[\\s\\-_]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"


def sql_slug(c: str) -> str:
    return f"(CASE WHEN {sql_key(c)} = '' THEN 'unknown' ELSE replace({sql_key(c)}, ' ', '_') END)"


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "duels": ((), f"""
SELECT {_K} AS match_id, o_orderdate + to_seconds({_K} % 86400) AS kickoff_at,
  o_orderpriority AS competition_id, {sql_pick(STAGES, f'{_K} % 12')} AS stage,
  CAST(year(o_orderdate) AS VARCHAR) AS season_or_year,
  {_TEAM.format('o_custkey % 25')} AS home_team_id,
  {_TEAM.format(f'(o_custkey + 1 + {_K} % 24) % 25')} AS away_team_id,
  {_HG} AS home_goals_90, {_AG} AS away_goals_90,
  CASE WHEN {_HG} > {_AG} THEN true WHEN {_HG} < {_AG} THEN false
    WHEN {_K} % 97 <> 13 AND {_K} % 12 IN (0, 9) THEN NULL ELSE o_custkey % 2 = 0 END AS home_advances,
  o_orderstatus = 'F' AS neutral_venue
FROM orders"""),
    "results": (("duels",), "SELECT * FROM duels WHERE home_advances IS NOT NULL"),
    "spine": (("duels",), "SELECT *, kickoff_at - INTERVAL 24 HOUR AS cutoff_time FROM duels"),
    "competitions": ((), """
SELECT DISTINCT o_orderpriority AS competition_id,
  0.5 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 0.5::DOUBLE AS importance_weight
FROM orders WHERE o_orderpriority NOT LIKE '4%'"""),
    "quotes": ((), f"""
SELECT l_partkey AS match_id, 'book_' || CAST(l_suppkey % 5 AS VARCHAR) AS bookmaker,
  {sql_pick(MARKETS, "(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE (CASE l_orderkey % 16 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END) END)")} AS market_type,
  CASE WHEN l_linenumber = 7 THEN 'Draw' WHEN l_linenumber % 2 = 1 THEN 'Home' ELSE 'away_to_advance' END AS selection,
  1.01::DOUBLE + l_quantity / 10 AS decimal_odds, l_shipdate + to_hours(l_linenumber) AS captured_at,
  l_linestatus = 'O' AND l_linenumber = 4 AS is_live, l_orderkey * 10 + l_linenumber AS quote_seq
FROM lineitem"""),
    "cutoffs": ((), "SELECT DISTINCT l_partkey AS match_id, TIMESTAMP '2000-01-01' AS cutoff_time FROM lineitem"),
    "availability": (("duels",), f"""
SELECT d.match_id, event_id AS record_id,
  CASE WHEN event_id % 2 = 0 THEN home_team_id ELSE away_team_id END AS team_id,
  {sql_pick(STATUSES, f'{_JK} % 7')} AS availability_status,
  {sql_pick(ROLES, f'({_JK} // 7) % 5')} AS role, {_JK} / 100.0::DOUBLE AS confidence, {_PUB} AS published_at
FROM events JOIN duels d ON d.match_id = event_id // 4"""),
    "shots": (("duels",), f"""
SELECT d.match_id, event_id,
  CASE WHEN event_type = 'purchase' THEN 'Shot' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS type_name,
  CASE {_JK} % 3 WHEN 0 THEN home_team_id WHEN 1 THEN away_team_id END AS team_id,
  floor(value) / 1000.0::DOUBLE AS xg, {sql_pick(PATTERNS, f'({_JK} // 3) % 4')} AS play_pattern
FROM events JOIN duels d ON d.match_id = event_id // 20"""),
    "shot_meta": (("duels",), "SELECT match_id, kickoff_at AS match_at, home_team_id, away_team_id FROM duels"),
    "raw_names": ((), f"""
SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 2 AND c_custkey % 20 < 13
  THEN {sql_pick(NAMES, 'c_custkey % 20')} || ' ' || CAST(c_custkey % 97 AS VARCHAR)
  ELSE {sql_pick(NAMES, 'c_custkey % 20')} END AS raw_name
FROM customer"""),
    "scored": (("duels", "results"), f"""
SELECT r.match_id, ({_V} % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS home_advance_probability,
  CASE WHEN {_K} % 7 <> 0 THEN ({_V} * 7 % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE END AS market_probability,
  CASE WHEN {_K} % 11 <> 0 THEN ({_V} * 3 % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE END AS elo_probability,
  'fold_' || season_or_year AS fold, kickoff_at, home_team_id, away_team_id,
  CAST(home_advances AS INTEGER) AS home_advances
FROM orders JOIN results r ON r.match_id = {_K}"""),
    "doc_scored": ((), """
SELECT l.doc_id, d.source AS fold, l.quality AS y, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS p
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""),
    "team_rows": (("duels", "results"), """
SELECT match_id, kickoff_at, home_team_id AS team_id, away_team_id AS opponent_id, home_goals_90 AS goals_for,
  away_goals_90 AS goals_against, home_advances AS advances, true AS is_home FROM results
UNION ALL
SELECT match_id, kickoff_at, away_team_id, home_team_id, away_goals_90, home_goals_90, NOT home_advances, false FROM results"""),
    "team_cutoffs": (("duels", "spine"), """
SELECT DISTINCT team_id, cutoff_time FROM (
  SELECT home_team_id AS team_id, cutoff_time FROM spine UNION ALL SELECT away_team_id, cutoff_time FROM spine)"""),
}


def sql_with(views: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the views it needs, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEW_SQL[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n][1].strip()})" for n in order)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE'):].strip()}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:].strip()}"
    return f"WITH {ctes}\n{text}"
