"""Form, rest, last-N and scalar time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.functions import probability as P
from cutline.functions import timeutil as T
from cutline.operators import form as O
from cutline.operators.features import team_cutoffs
from cutline.operators.pit import latest_at

REGISTRY = Registry()
query = REGISTRY.query

AGE = "(epoch_us(c.cutoff_time) - epoch_us(t.kickoff_at)) / 86400000000.0::DOUBLE"


@query(
    "decayed_form",
    f"""SELECT c.team_id, c.cutoff_time,
      round(coalesce(sum(exp(-ln(2) * {AGE} / 180) * CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END)
        / sum(exp(-ln(2) * {AGE} / 180)), 0), 6) AS weighted_points,
      round(coalesce(sum(exp(-ln(2) * {AGE} / 180) * (goals_for - goals_against)) / sum(exp(-ln(2) * {AGE} / 180)), 0), 6) + 0.0 AS weighted_goal_difference,
      coalesce(CAST(floor(min({AGE})) AS INTEGER), 7) AS rest_days, max(t.kickoff_at) AS last_match_at
    FROM team_cutoffs c LEFT JOIN team_rows t ON t.team_id = c.team_id AND t.kickoff_at < c.cutoff_time
      AND goals_for IS NOT NULL AND goals_against IS NOT NULL
    GROUP BY ALL""",
    ("team_cutoffs", "team_rows"),
)
def decayed_form(v):
    """Decayed points and goal difference, and whole rest days, at every (team, cut-off)."""
    return O.decayed_form(O.team_rows(v.results), v.spine.select(
        F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "cutoff_time"))


@query(
    "decayed_form_short",
    f"""SELECT c.team_id, c.cutoff_time,
      round(coalesce(sum(exp(-ln(2) * {AGE} / 3) * CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END)
        / sum(exp(-ln(2) * {AGE} / 3)), 0), 6) AS weighted_points,
      round(coalesce(sum(exp(-ln(2) * {AGE} / 3) * (goals_for - goals_against)) / sum(exp(-ln(2) * {AGE} / 3)), 0), 6) + 0.0 AS weighted_goal_difference,
      coalesce(CAST(floor(min({AGE})) AS INTEGER), 7) AS rest_days, max(t.kickoff_at) AS last_match_at
    FROM team_cutoffs c LEFT JOIN team_rows t ON t.team_id = c.team_id AND t.kickoff_at < c.cutoff_time
      AND goals_for IS NOT NULL AND goals_against IS NOT NULL
    GROUP BY ALL""",
    ("team_cutoffs", "team_rows"),
)
def decayed_form_short(v):
    """A half life of three days: the history spans hundreds of half lives."""
    return O.decayed_form(O.team_rows(v.results), v.spine.select(
        F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "cutoff_time"), half_life_days=3.0)


@query(
    "team_rows",
    "SELECT match_id, kickoff_at, team_id, opponent_id, goals_for, goals_against, advances, is_home FROM team_rows",
    ("team_rows",),
)
def team_rows(v):
    return O.team_rows(v.results)


LASTN = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff_at, match_id DESC) AS rk FROM {src}),
known AS (
  SELECT c.team_id, c.cutoff_time, r.rk AS k FROM team_cutoffs c
  ASOF JOIN (SELECT team_id, kickoff_at, max(rk) AS rk FROM ranked GROUP BY ALL) r ON r.team_id = c.team_id AND r.kickoff_at < c.cutoff_time),
past AS (
  SELECT k.team_id, k.cutoff_time, k.k - r.rk + 1 AS recency, r.match_id, r.kickoff_at, r.opponent_id, r.goals_for, r.goals_against, r.advances
  FROM known k JOIN ranked r ON r.team_id = k.team_id AND r.rk BETWEEN k.k - {n} + 1 AND k.k)"""


@query(
    "last_five_results",
    f"WITH {LASTN.format(src='team_rows', n=5)} SELECT team_id, cutoff_time, recency, match_id, opponent_id FROM past",
    ("team_cutoffs", "team_rows"),
)
def last_five_results(v):
    """The five newest matches strictly before every cut-off."""
    return O.last_n(O.team_rows(v.results), team_cutoffs(v.spine), 5).select(
        "team_id", "cutoff_time", F.col("recency").cast("long").alias("recency"), "match_id", "opponent_id"
    )


@query(
    "last_match_before",
    """SELECT c.team_id, c.cutoff_time, t.kickoff_at AS last_match_at FROM team_cutoffs c
    ASOF LEFT JOIN (SELECT DISTINCT team_id, kickoff_at FROM team_rows) t ON t.team_id = c.team_id AND t.kickoff_at < c.cutoff_time""",
    ("team_cutoffs", "team_rows"),
)
def last_match_before(v):
    h = O.team_rows(v.results)
    return latest_at(
        h, team_cutoffs(v.spine), keys=["team_id"], ts="kickoff_at", at="cutoff_time",
        value="kickoff_at", out="last_match_at", inclusive=False,
    )


GD_PAST = LASTN.format(src="(SELECT * FROM team_rows WHERE goals_for IS NOT NULL AND goals_against IS NOT NULL)", n=8)
W365 = "exp(-ln(2) * ((epoch_us(cutoff_time) - epoch_us(kickoff_at)) / 86400000000.0::DOUBLE) / 365)"


@query(
    "decayed_goal_diff",
    f"""WITH {GD_PAST}
    SELECT c.team_id, c.cutoff_time, round(coalesce(g, 0), 6) + 0.0 AS goal_diff FROM team_cutoffs c LEFT JOIN (
      SELECT team_id, cutoff_time, sum({W365} * (goals_for - goals_against)) / sum({W365}) AS g FROM past GROUP BY ALL) p
    USING (team_id, cutoff_time)""",
    ("team_cutoffs", "team_rows"),
)
def decayed_goal_diff(v):
    return O.decayed_goal_diff(O.team_rows(v.results), team_cutoffs(v.spine))


ASKS = """asks AS (
  SELECT DISTINCT team_id, cutoff_time, opponent_id, 1400.0::DOUBLE + CAST(substr(opponent_id, 4) AS INTEGER) * 10 AS opponent_rating FROM (
    SELECT home_team_id AS team_id, cutoff_time, away_team_id AS opponent_id FROM spine
    UNION ALL SELECT away_team_id, cutoff_time, home_team_id FROM spine))"""


@query(
    "opponent_weighted_form",
    f"""WITH {LASTN.format(src='team_rows', n=5)}, {ASKS},
    w AS (SELECT a.*, {W365.replace('cutoff_time', 'a.cutoff_time')} * CASE WHEN p.opponent_id = a.opponent_id THEN a.opponent_rating ELSE 1500 END AS w,
        CASE WHEN p.advances THEN 3 WHEN p.goals_for IS NOT DISTINCT FROM p.goals_against THEN 1 ELSE 0 END AS points
      FROM asks a LEFT JOIN past p ON p.team_id = a.team_id AND p.cutoff_time = a.cutoff_time)
    SELECT team_id, cutoff_time, opponent_id, round(opponent_rating, 6) AS opponent_rating,
      round(coalesce(sum(w * points) / sum(w), 0), 6) AS form FROM w GROUP BY team_id, cutoff_time, opponent_id, opponent_rating""",
    ("team_cutoffs", "team_rows", "spine"),
)
def opponent_weighted_form(v):
    rating = lambda o: (1400.0 + F.substring(o, 4, 2).cast("int") * 10).alias("opponent_rating")
    s = v.spine
    side = lambda t, o: s.select(F.col(t).alias("team_id"), "cutoff_time", F.col(o).alias("opponent_id"), rating(o))
    asks = side("home_team_id", "away_team_id").unionByName(side("away_team_id", "home_team_id")).distinct()
    return O.opponent_weighted_form(O.team_rows(v.results), asks)


@query(
    "rest_days_v1",
    """SELECT s.match_id, round(coalesce((epoch_us(s.kickoff_at) - epoch_us(t.kickoff_at)) / 86400000000.0::DOUBLE, 7) * 86400, 0) AS rest_seconds_home
    FROM spine s ASOF LEFT JOIN (SELECT DISTINCT team_id, kickoff_at FROM team_rows) t
      ON t.team_id = s.home_team_id AND t.kickoff_at < s.cutoff_time""",
    ("spine", "team_rows"),
)
def rest_days_v1(v):
    last = latest_at(
        O.team_rows(v.results), team_cutoffs(v.spine), keys=["team_id"], ts="kickoff_at", at="cutoff_time",
        value="kickoff_at", out="last_match_at", inclusive=False,
    ).withColumnRenamed("team_id", "home_team_id")
    return v.spine.join(last, ["home_team_id", "cutoff_time"], "left").select(
        "match_id", F.round(O.rest_days_v1("kickoff_at", "last_match_at") * 86400, 0).alias("rest_seconds_home")
    )


@query(
    "decay_weights",
    """SELECT o_orderkey, round(exp(-ln(2) * age / 180), 6) AS form_weight,
      round(CASE WHEN age < 0 THEN 0 ELSE exp(-ln(2) * age / 365) END, 6) AS v1_weight, 1.0::DOUBLE AS no_half_life
    FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '2001-01-01') - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS age FROM orders)""",
)
def decay_weights(v):
    age = T.days_between(F.to_timestamp(F.lit("2001-01-01")), F.col("o_orderdate").cast("timestamp"))
    return v.table("orders").select(
        "o_orderkey", P.decay(age, 180.0).alias("form_weight"), P.decay(age, 365.0, True).alias("v1_weight"),
        P.decay(age, 0.0).alias("no_half_life"),
    )


@query(
    "to_utc",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN kickoff_at - INTERVAL 2 HOUR
        WHEN 1 THEN date_trunc('day', kickoff_at) ELSE kickoff_at END AS parsed
    FROM orders JOIN duels ON match_id = o_orderkey""",
    ("duels",),
)
def to_utc(v):
    """ISO text in several shapes: Z, bare date, offset, garbage, null, naive."""
    iso = F.date_format("kickoff_at", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("match_id") % 6
    text = (
        F.when(k == 0, F.concat(iso, F.lit("Z")))
        .when(k == 1, F.date_format("kickoff_at", "yyyy-MM-dd"))
        .when(k == 2, F.concat(iso, F.lit("+02:00")))
        .when(k == 3, F.concat(F.lit("on "), iso))
        .when(k == 5, F.concat(F.lit(" "), iso, F.lit(" ")))
    )
    return v.duels.select(F.col("match_id").alias("o_orderkey"), T.to_utc(text).alias("parsed"))


@query(
    "cutoff_checks",
    """SELECT match_id, cutoff_time < kickoff_at AS valid, kickoff_at < TIMESTAMP '1998-06-01' AS observed FROM (
      SELECT match_id, kickoff_at, kickoff_at + to_hours(CAST(match_id % 5 - 3 AS BIGINT)) AS cutoff_time FROM duels)""",
    ("duels",),
)
def cutoff_checks(v):
    cut = F.timestamp_seconds(F.unix_seconds("kickoff_at") + (F.col("match_id") % 5 - 3) * 3600)
    return v.duels.withColumn("cutoff_time", cut).select(
        "match_id", T.cutoff_before("cutoff_time", "kickoff_at").alias("valid"),
        T.observed_before("kickoff_at", F.to_timestamp(F.lit("1998-06-01"))).alias("observed"),
    )


@query("chronological_order", "SELECT match_id, kickoff_at FROM duels ORDER BY kickoff_at, match_id", ("duels",))
def chronological_order(v):
    return v.duels.select("match_id", "kickoff_at").orderBy("kickoff_at", "match_id")
