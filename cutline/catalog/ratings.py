"""Rating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.functions import probability as P
from cutline.operators import elo as E

REGISTRY = Registry()
query = REGISTRY.query

FLAT = E.EloConfig()
DECAYED = E.EloConfig(time_decay_per_day=0.0005, mov_multiplier=1.0, equal_time="last")


def elo_sql(
    decay: float = 0.0, mov: bool = False, importance: bool = False, src: str = "duels", edge: float = 60.0, fixed: str = "1.0",
    first: bool = True,
) -> str:
    """Step through each pool's matches in order; ratings and their times live in two lists.

    With ``first``, a second match of a team at the same instant leaves its stored rating alone.
    """
    own = lambda side: f"WHEN {side} THEN CASE WHEN t[{side}] = us THEN x ELSE {side}0 {'+' if side == 'h' else '-'} d END" if first else f"WHEN {side} THEN {side}0 {'+' if side == 'h' else '-'} d"
    tie = "arg_min" if first else "arg_max"
    imp = "coalesce(c.importance_weight, 1.0)" if importance else fixed
    imp_join = "LEFT JOIN competitions c USING (competition_id)" if importance else ""
    rate = (
        "st.r[{i}] * exp(-" + repr(decay) + "::DOUBLE * greatest(0, m.us - st.t[{i}]) / 86400000000.0::DOUBLE)"
        if decay else "st.r[{i}]"
    )
    step = "m.k * m.mov" if mov else "m.k"
    return f"""WITH RECURSIVE
m AS MATERIALIZED (
  SELECT competition_id AS pool, match_id, home_team_id, away_team_id, kickoff_at,
    row_number() OVER (PARTITION BY competition_id ORDER BY kickoff_at, match_id) AS n,
    epoch_us(kickoff_at) AS us,
    CAST(substr(home_team_id, 4) AS INTEGER) + 1 AS h, CAST(substr(away_team_id, 4) AS INTEGER) + 1 AS a,
    CASE WHEN home_advances THEN 1.0::DOUBLE WHEN NOT home_advances THEN 0.0 WHEN home_goals_90 > away_goals_90 THEN 1.0
      WHEN home_goals_90 < away_goals_90 THEN 0.0 ELSE 0.5 END AS score,
    CASE WHEN neutral_venue THEN 0.0::DOUBLE ELSE {edge} END AS edge,
    greatest(5.0, least(40.0, 20.0::DOUBLE * {imp})) AS k,
    coalesce(1 + log2(1 + abs(home_goals_90 - away_goals_90)), 1.0) AS mov
  FROM {src} {imp_join} WHERE home_advances IS NOT NULL OR (home_goals_90 IS NOT NULL AND away_goals_90 IS NOT NULL)),
st AS (
  SELECT DISTINCT pool, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS match_id,
    list_transform(range(25), lambda x: 1500.0::DOUBLE) AS r, list_transform(range(25), lambda x: 0::BIGINT) AS t,
    0.0::DOUBLE AS h0, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS h1, 0.0::DOUBLE AS a1 FROM m
  UNION ALL
  SELECT pool, n, match_id,
    list_transform(r, lambda x, i: CASE i {own('h')} {own('a')} ELSE x END),
    list_transform(t, lambda x, i: CASE WHEN i = h OR i = a THEN us ELSE x END),
    h0, a0, h0 + d, a0 - d
  FROM (
    SELECT *, step * (score - 1 / (1 + pow(10.0::DOUBLE, (a0 - h0 - edge) / 400))) AS d FROM (
      SELECT st.pool, m.n, m.match_id, st.r, st.t, m.h, m.a, m.us, m.score, m.edge, {step} AS step,
        CASE WHEN st.t[m.h] = 0 THEN 1500.0::DOUBLE ELSE {rate.format(i='m.h')} END AS h0,
        CASE WHEN st.t[m.a] = 0 THEN 1500.0::DOUBLE ELSE {rate.format(i='m.a')} END AS a0
      FROM st JOIN m ON m.pool = st.pool AND m.n = st.n + 1))),
hist AS MATERIALIZED (
  SELECT st.pool, st.match_id, m.kickoff_at, m.home_team_id AS team_id, h0 AS rating_before, h1 AS rating FROM st JOIN m USING (pool, match_id)
  UNION ALL
  SELECT st.pool, st.match_id, m.kickoff_at, m.away_team_id, a0, a1 FROM st JOIN m USING (pool, match_id)),
hist_at AS (SELECT team_id, kickoff_at, {tie}(rating, match_id) AS rating FROM hist GROUP BY ALL)"""


def history(v, config=FLAT, importance=False, max_rows=E.MAX_ROWS_PER_TASK, pools=False):
    m = v.duels
    if importance:
        m = m.join(v.competitions, "competition_id", "left")
    return E.elo_ratings(m, config, importance="importance_weight" if importance else None, max_rows_per_task=max_rows, pools=pools)



HISTORY_SELECT = """
SELECT min(team_id) OVER (PARTITION BY pool) AS pool, CAST(match_id AS VARCHAR) AS match_key, team_id, kickoff_at, round(rating_before, 6) AS rating_before,
  round(rating, 6) AS rating FROM hist"""


@query("elo_ratings", elo_sql() + HISTORY_SELECT, ("duels",))
def elo_ratings(v):
    return history(v, pools=True).drop("seq")


@query("elo_ratings_decay_margin", elo_sql(0.0005, True, True, first=False) + HISTORY_SELECT, ("duels", "competitions"))
def elo_ratings_decay_margin(v):
    return history(v, DECAYED, True, pools=True).drop("seq")


@query("elo_ratings_in_time_slices", elo_sql() + HISTORY_SELECT, ("duels",))
def elo_ratings_in_time_slices(v):
    """The same history from some fifteen time slices that are scanned side by side until their starts agree."""
    return history(v, max_rows=max(1, v.duels.count() // 15), pools=True).drop("seq")


@query(
    "rating_history",
    elo_sql() + """
SELECT min(team_id) OVER (PARTITION BY pool) AS pool, team_id, matches, best, latest FROM (
  SELECT pool, team_id, count(*) AS matches, round(max(rating), 6) AS best, round(arg_max(rating, (kickoff_at, match_id)), 6) AS latest
  FROM hist GROUP BY ALL)""",
    ("duels",),
)
def rating_history(v):
    return history(v, pools=True).groupBy("pool", "team_id").agg(
        F.count(F.lit(1)).alias("matches"), F.max("rating").alias("best"),
        F.max_by("rating", F.struct("kickoff_at", "seq")).alias("latest"),
    )


@query(
    "elo_zero_sum",
    elo_sql() + """
SELECT min(team_id) AS pool, count(*) AS updates, round(sum(rating - rating_before), 6) + 0.0 AS drift FROM hist GROUP BY hist.pool""",
    ("duels",),
)
def elo_zero_sum(v):
    steps = E.rating_steps(history(v, pools=True))
    return steps.groupBy("pool").agg(F.count(F.lit(1)).alias("updates"), F.sum("delta").alias("drift"))


ASOF = """, at_cut AS MATERIALIZED (
  SELECT c.team_id, c.cutoff_time, coalesce(h.rating, 1500.0) AS rating
  FROM team_cutoffs c ASOF LEFT JOIN hist_at h ON c.team_id = h.team_id AND h.kickoff_at <= c.cutoff_time)"""


@query(
    "rating_asof",
    elo_sql() + ASOF + " SELECT team_id, cutoff_time, round(rating, 6) AS rating FROM at_cut",
    ("duels", "team_cutoffs"),
)
def rating_asof(v):
    from cutline.operators.features import team_cutoffs

    return E.rating_asof(history(v), team_cutoffs(v.spine), FLAT)


@query(
    "rating_asof_strict",
    elo_sql() + """
  SELECT c.team_id, c.kickoff_at, round(coalesce(h.rating, 1500.0), 6) AS rating
  FROM (SELECT DISTINCT team_id, kickoff_at FROM (SELECT home_team_id AS team_id, kickoff_at FROM duels UNION ALL
        SELECT away_team_id, kickoff_at FROM duels)) c
  ASOF LEFT JOIN hist_at h ON c.team_id = h.team_id AND h.kickoff_at < c.kickoff_at""",
    ("duels",),
)
def rating_asof_strict(v):
    teams = v.duels.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "kickoff_at")
    return E.rating_asof(history(v), teams, FLAT, at="kickoff_at", inclusive=False)


@query(
    "elo_probability",
    elo_sql() + ASOF + """
SELECT s.match_id, round(h.rating, 6) AS home_rating, round(a.rating, 6) AS away_rating,
  round(1 / (1 + pow(10.0::DOUBLE, (a.rating - h.rating - CASE WHEN neutral_venue THEN 0 ELSE 60 END) / 400)), 6) AS elo_home_advance_probability
FROM spine s JOIN at_cut h ON h.team_id = s.home_team_id AND h.cutoff_time = s.cutoff_time
JOIN at_cut a ON a.team_id = s.away_team_id AND a.cutoff_time = s.cutoff_time""",
    ("duels", "spine", "team_cutoffs"),
)
def elo_probability(v):
    return E.elo_probability(v.spine, history(v), FLAT).select(
        "match_id", "home_rating", "away_rating", "elo_home_advance_probability"
    )


@query(
    "elo_training_slice",
    elo_sql() + """
SELECT min(team_id) AS pool, count(*) AS updates, round(sum(rating), 4) AS total FROM hist WHERE kickoff_at < TIMESTAMP '1998-01-01' GROUP BY hist.pool""",
    ("duels",),
)
def elo_training_slice(v):
    """Ratings known at a training start: later matches never change earlier ratings."""
    before = v.duels.filter(F.col("kickoff_at") < F.to_timestamp(F.lit("1998-01-01")))
    h = E.elo_ratings(before, FLAT, pools=True)
    return h.groupBy("pool").agg(F.count(F.lit(1)).alias("updates"), F.round(F.sum("rating"), 4).alias("total"))


@query(
    "elo_expected",
    "SELECT o_orderkey, round(1 / (1 + pow(10.0::DOUBLE, ((o_totalprice % 997) - (o_custkey % 800)) / 400)), 6) AS expected FROM orders",
)
def elo_expected(v):
    return v.table("orders").select(
        "o_orderkey",
        P.expected_score(F.col("o_custkey") % 800, F.col("o_totalprice") % 997).alias("expected"),
    )


@query(
    "advance_probability",
    """SELECT match_id, round(0.5 * p - 0.5 * (1 - p) + 0.5, 6) AS draw_50_50, round(greatest(p, 0.5), 6) AS extra_time,
      0.5::DOUBLE AS penalties, round(p, 6) AS ignore_draws FROM (SELECT match_id, home_advance_probability AS p FROM scored)""",
    ("scored",),
)
def advance_probability(v):
    p = "home_advance_probability"
    names = ("draw_50_50", "extra_time", "penalties", "ignore_draws")
    return v.scored.select(
        "match_id", *[P.advance_probability(p, r).alias(n) for n, r in zip(names, P.TIE_RULES, strict=True)]
    )


@query(
    "k_factor",
    "SELECT o_orderkey, round(greatest(5, least(40, 20 * (o_totalprice % 300) / 100)), 6) AS k FROM orders",
)
def k_factor(v):
    return v.table("orders").select("o_orderkey", P.k_factor((F.col("o_totalprice") % 300) / 100).alias("k"))


@query(
    "mov_multiplier",
    "SELECT match_id, round(coalesce(1 + log2(1 + abs(home_goals_90 - away_goals_90)), 1.0), 6) AS mov FROM duels",
    ("duels",),
)
def mov_multiplier(v):
    return v.duels.select("match_id", P.mov_multiplier("home_goals_90", "away_goals_90").alias("mov"))
