"""Feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.events import DIFFS, LINEUP, TOTALS
from cutline.catalog.form import AGE, GD_PAST, LASTN, W365
from cutline.catalog.market import CONSENSUS
from cutline.catalog.names import CANON
from cutline.catalog.ratings import elo_sql
from cutline.catalog.registry import Registry
from cutline.functions.stages import stage_canonical
from cutline.functions.timeutil import hours_before
from cutline.operators import elo as E
from cutline.operators import features as O
from cutline.operators import lineup as L
from cutline.operators.folds import mirror
from cutline.plans.store import materialize

REGISTRY = Registry()
query = REGISTRY.query

CONFIG = E.EloConfig()
V1_CONFIG = E.EloConfig(home_advantage=0.0)


def rating_table(v, config=CONFIG):
    """The rating history as a stored table: later jobs read it, none refits it."""
    rows = v.results.join(v.competitions, "competition_id", "left")
    return materialize(E.elo_ratings(rows, config, importance="importance_weight", pools=False).select(*E.LOOKED_UP), "ratings")


def features(v):
    """The full table at kickoff minus 24 hours."""
    return O.feature_table(
        v.spine, results=v.results, ratings=rating_table(v), quotes=v.quotes, availability=v.availability,
        competitions=v.competitions, events=v.shots, event_meta=v.shot_meta, config=CONFIG, quote_order=["quote_seq"],
    )



FORM_SQL = f"""form AS (
  SELECT c.team_id, c.cutoff_time,
    coalesce(sum(exp(-ln(2) * {AGE} / 180) * CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) / sum(exp(-ln(2) * {AGE} / 180)), 0) AS pts,
    coalesce(sum(exp(-ln(2) * {AGE} / 180) * (goals_for - goals_against)) / sum(exp(-ln(2) * {AGE} / 180)), 0) AS gd,
    coalesce(CAST(floor(min({AGE})) AS INTEGER), 7) AS rest, max(t.kickoff_at) AS last_at
  FROM team_cutoffs c LEFT JOIN team_rows t ON t.team_id = c.team_id AND t.kickoff_at < c.cutoff_time AND goals_for IS NOT NULL AND goals_against IS NOT NULL
  GROUP BY ALL)"""
ELO_AT = """elo_at AS (
  SELECT c.team_id, c.cutoff_time, coalesce(h.rating, 1500.0) AS rating, h.kickoff_at AS rating_at
  FROM team_cutoffs c ASOF LEFT JOIN hist_at h ON c.team_id = h.team_id AND h.kickoff_at <= c.cutoff_time)"""
EVENT_AT = """ev_at AS (
  SELECT c.team_id, c.cutoff_time, round(sum(xg), 4) AS xg, sum(box) AS box, round(sum(spxg), 4) AS spxg, count(e.team_id) AS used, max(e.match_at) AS event_at
  FROM team_cutoffs c LEFT JOIN ehist e ON e.team_id = c.team_id AND e.match_at < c.cutoff_time GROUP BY ALL)"""
SIDES = """
LEFT JOIN elo_at eh ON eh.team_id = s.home_team_id AND eh.cutoff_time = s.cutoff_time LEFT JOIN elo_at ea ON ea.team_id = s.away_team_id AND ea.cutoff_time = s.cutoff_time
LEFT JOIN form fh ON fh.team_id = s.home_team_id AND fh.cutoff_time = s.cutoff_time LEFT JOIN form fa ON fa.team_id = s.away_team_id AND fa.cutoff_time = s.cutoff_time
LEFT JOIN ev_at vh ON vh.team_id = s.home_team_id AND vh.cutoff_time = s.cutoff_time LEFT JOIN ev_at va ON va.team_id = s.away_team_id AND va.cutoff_time = s.cutoff_time
LEFT JOIN consensus m ON m.match_id = s.match_id AND m.cutoff_time = s.cutoff_time LEFT JOIN choice mc ON mc.match_id = m.match_id AND mc.cutoff_time = m.cutoff_time
LEFT JOIN counts h ON h.match_id = s.match_id AND h.cutoff_time = s.cutoff_time AND h.team_id = s.home_team_id
LEFT JOIN counts a ON a.match_id = s.match_id AND a.cutoff_time = s.cutoff_time AND a.team_id = s.away_team_id
LEFT JOIN (SELECT match_id, max(published_at) AS avail_at FROM seen GROUP BY 1) av ON av.match_id = s.match_id
LEFT JOIN competitions cp ON cp.competition_id = s.competition_id"""
BASE = ",\n".join([
    elo_sql(importance=True, src="results"), ELO_AT, FORM_SQL, TOTALS.replace("hist AS (", "ehist AS ("), EVENT_AT,
    CONSENSUS.format(spine="spine", least=1), LINEUP,
])
VIEWS = ("duels", "results", "spine", "competitions", "quotes", "availability", "shots", "shot_meta", "team_rows", "team_cutoffs")
KNOCKOUT = """NOT regexp_matches(lower(stage), 'group|league|round robin|round-robin') AND
  regexp_matches(lower(stage), 'round of 16|r16|round-of-16|quarter|qf|semi|sf|final|3rd place|third place|play-off|playoff|knockout')"""
PLAIN = {
    "home_elo_pre_match": "eh.rating", "away_elo_pre_match": "ea.rating", "elo_difference": "eh.rating - ea.rating",
    "elo_home_advance_probability": "1 / (1 + pow(10.0::DOUBLE, (ea.rating - eh.rating - CASE WHEN neutral_venue THEN 0 ELSE 60 END) / 400))",
    "home_form_points": "fh.pts", "away_form_points": "fa.pts", "form_points_difference": "fh.pts - fa.pts",
    "home_goal_difference_recent": "fh.gd", "away_goal_difference_recent": "fa.gd", "goal_difference_recent_diff": "fh.gd - fa.gd",
    "rest_days_home": "fh.rest::DOUBLE", "rest_days_away": "fa.rest::DOUBLE", "rest_days_difference": "(fh.rest - fa.rest)::DOUBLE",
    "market_overround": "coalesce(raw_home + raw_away - 1, 0)", "market_dispersion": "coalesce(dispersion, 0)",
    "market_home_advance_probability": "coalesce(ph_avg / (ph_avg + pa_avg), 0.5)", "market_probability": "ph_avg / (ph_avg + pa_avg)",
    "competition_importance": "coalesce(importance_weight, 1.0)",
    "events_xg_home": "vh.xg", "events_xg_away": "va.xg", "events_xg_difference": "vh.xg - va.xg",
    "events_shots_in_box_home": "vh.box", "events_shots_in_box_away": "va.box",
    "events_set_piece_xg_difference": "coalesce(vh.spxg, 0) - coalesce(va.spxg, 0)",
}
FEATURE_SELECT = ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in PLAIN.items()) + """,
  ph_avg IS NOT NULL AS market_available, coalesce(bookmaker_count, 0) AS market_bookmaker_count, neutral_venue, """ + KNOCKOUT + """ AS is_knockout,
  vh.used > 0 OR va.used > 0 AS events_available,
  greatest(eh.rating_at, fh.last_at, vh.event_at, ea.rating_at, fa.last_at, va.event_at, mc.most_recent_captured_at, av.avail_at) AS source_data_max_timestamp, """ + ", ".join(
    f"coalesce({p}.{c}, 0) AS {side}_{c}" for side, p in (("home", "h"), ("away", "a")) for c in L.LINEUP_COLUMNS
) + ", " + DIFFS


@query(
    "feature_table",
    f"{BASE} SELECT s.match_id, s.cutoff_time, s.kickoff_at, s.home_team_id, s.away_team_id, {FEATURE_SELECT} FROM spine s {SIDES}",
    VIEWS,
)
def feature_table(v):
    return features(v)


@query(
    "training_table",
    f"""{BASE} SELECT s.match_id, CAST(s.home_advances AS INTEGER) AS home_advances, {", ".join(f"round({PLAIN[n]}, 6) + 0.0 AS {n}" for n in ("elo_difference", "form_points_difference", "market_home_advance_probability", "competition_importance"))}
    FROM spine s {SIDES} WHERE s.home_advances IS NOT NULL AND s.kickoff_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""",
    VIEWS,
)
def training_table(v):
    from cutline.plans.training import training_table as table

    ts = lambda s: F.to_timestamp(F.lit(s))
    return table(features(v), v.results, ts("1996-01-01"), ts("1999-12-31")).select(
        "match_id", "home_advances", "elo_difference", "form_points_difference", "market_home_advance_probability",
        "competition_importance",
    )


@query(
    "feature_cutoffs",
    """SELECT match_id, label, cutoff_time, cutoff_time < kickoff_at AS valid FROM (
      SELECT match_id, kickoff_at, 'T-24h' AS label, kickoff_at - INTERVAL 24 HOUR AS cutoff_time FROM duels
      UNION ALL SELECT match_id, kickoff_at, 'T-6h', kickoff_at - INTERVAL 6 HOUR FROM duels
      UNION ALL SELECT match_id, kickoff_at, 'T-75min', kickoff_at - INTERVAL 75 MINUTE FROM duels
      UNION ALL SELECT match_id, kickoff_at, 'late', kickoff_at FROM duels)""",
    ("duels",),
)
def feature_cutoffs(v):
    """All configured cut-offs of every match, and one at kickoff that must be refused."""
    hours = {**O.CUTOFFS_HOURS, "late": 0.0}
    labels = F.array(*[F.struct(F.lit(n).alias("label"), hours_before("kickoff_at", h).alias("cutoff_time")) for n, h in hours.items()])
    rows = v.duels.select("match_id", "kickoff_at", F.explode(labels).alias("c")).select("match_id", "kickoff_at", "c.*")
    good, bad = O.split_valid_cutoffs(rows)
    cols = ["match_id", "label", "cutoff_time"]
    return good.select(*cols, F.lit(True).alias("valid")).unionByName(bad.select(*cols, F.lit(False).alias("valid")))


# -- pre-registered features -----------------------------------------------------------------

def v1_matches(v):
    return v.results.withColumn("stage_canonical", stage_canonical("stage")).select(
        "match_id", "kickoff_at", "home_team_id", "away_team_id", "stage_canonical"
    )


def v1_ratings(v):
    rows = v.results.withColumns({"neutral_venue": F.lit(True), "importance": F.lit(2.0)})
    return materialize(E.elo_ratings(rows, V1_CONFIG, importance="importance", pools=False).select(*E.LOOKED_UP), "ratings")


def v1_features(v):
    return O.v1_feature_table(v1_matches(v), v.results, v1_ratings(v))


V1_SQL = ",\n".join([
    elo_sql(src="results", edge=0.0, fixed="2.0"), ELO_AT,
    LASTN.format(src="team_rows", n=5),
    GD_PAST.replace("ranked AS", "granked AS").replace("FROM ranked", "FROM granked").replace("JOIN ranked", "JOIN granked")
    .replace("known AS", "gknown AS").replace("FROM known", "FROM gknown").replace("past AS", "gpast AS"),
    """asks AS (
  SELECT s.match_id, true AS home, s.home_team_id AS team_id, s.cutoff_time, s.away_team_id AS opponent_id, ea.rating AS opponent_rating
  FROM spine s JOIN elo_at ea ON ea.team_id = s.away_team_id AND ea.cutoff_time = s.cutoff_time
  UNION ALL SELECT s.match_id, false, s.away_team_id, s.cutoff_time, s.home_team_id, eh.rating
  FROM spine s JOIN elo_at eh ON eh.team_id = s.home_team_id AND eh.cutoff_time = s.cutoff_time)""",
    f"""fw AS (
  SELECT match_id, home, coalesce(sum(w * points) / sum(w), 0) AS form FROM (
    SELECT a.match_id, a.home, {W365.replace('cutoff_time', 'a.cutoff_time')} * CASE WHEN p.opponent_id = a.opponent_id THEN a.opponent_rating ELSE 1500 END AS w,
      CASE WHEN p.advances THEN 3 WHEN p.goals_for IS NOT DISTINCT FROM p.goals_against THEN 1 ELSE 0 END AS points
    FROM asks a LEFT JOIN past p ON p.team_id = a.team_id AND p.cutoff_time = a.cutoff_time) GROUP BY ALL)""",
    f"gw AS (SELECT team_id, cutoff_time, sum({W365} * (goals_for - goals_against)) / sum({W365}) AS g FROM gpast GROUP BY ALL)",
    """lastm AS (SELECT c.team_id, c.cutoff_time, t.kickoff_at AS l FROM team_cutoffs c
  ASOF LEFT JOIN (SELECT DISTINCT team_id, kickoff_at FROM team_rows) t ON t.team_id = c.team_id AND t.kickoff_at < c.cutoff_time)""",
    f"""v1 AS (
  SELECT s.match_id, s.home_team_id, s.away_team_id, eh.rating - ea.rating AS elo_difference, 1 / (1 + pow(10.0::DOUBLE, (ea.rating - eh.rating) / 400)) AS elo_home_win_prob,
    wh.form - wa.form AS form_difference, wh.form AS form_home, wa.form AS form_away, coalesce(gh.g, 0) - coalesce(ga.g, 0) AS goal_diff_difference,
    coalesce(gh.g, 0) AS goal_diff_home, coalesce(ga.g, 0) AS goal_diff_away,
    coalesce((epoch_us(s.kickoff_at) - epoch_us(lh.l)) / 1000000.0::DOUBLE, 604800) AS rest_home, coalesce((epoch_us(s.kickoff_at) - epoch_us(la.l)) / 1000000.0::DOUBLE, 604800) AS rest_away,
    {CANON} AS c
  FROM spine s JOIN elo_at eh ON eh.team_id = s.home_team_id AND eh.cutoff_time = s.cutoff_time JOIN elo_at ea ON ea.team_id = s.away_team_id AND ea.cutoff_time = s.cutoff_time
  JOIN fw wh ON wh.match_id = s.match_id AND wh.home JOIN fw wa ON wa.match_id = s.match_id AND NOT wa.home
  LEFT JOIN gw gh ON gh.team_id = s.home_team_id AND gh.cutoff_time = s.cutoff_time LEFT JOIN gw ga ON ga.team_id = s.away_team_id AND ga.cutoff_time = s.cutoff_time
  LEFT JOIN lastm lh ON lh.team_id = s.home_team_id AND lh.cutoff_time = s.cutoff_time LEFT JOIN lastm la ON la.team_id = s.away_team_id AND la.cutoff_time = s.cutoff_time
  WHERE s.home_advances IS NOT NULL)""",
])
V1_NUM = ["elo_difference", "elo_home_win_prob", "form_difference", "form_home", "form_away", "goal_diff_difference", "goal_diff_home", "goal_diff_away"]
V1_ONE = ["round_of_16", "quarter_final", "semi_final", "final"]
V1_SELECT = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in V1_NUM) + ", " + ", ".join(f"CAST(c = '{s}' AS INTEGER) AS is_{s}" for s in V1_ONE)
V1_VIEWS = ("duels", "results", "spine", "team_rows", "team_cutoffs")


def _seconds(df):
    """Rest days as whole seconds, free of rounding ties."""
    s = lambda c: F.round(F.col(c) * 86400, 0)
    return df.withColumns({
        "rest_seconds_home": s("rest_days_home"), "rest_seconds_away": s("rest_days_away"),
        "rest_seconds_difference": s("rest_days_difference"),
    })


V1_COLS = [*V1_NUM, *[f"is_{s}" for s in V1_ONE], "rest_seconds_home", "rest_seconds_away", "rest_seconds_difference"]


@query(
    "v1_feature_table",
    f"""{V1_SQL} SELECT match_id, home_team_id, away_team_id, {V1_SELECT}, round(rest_home, 0) AS rest_seconds_home, round(rest_away, 0) AS rest_seconds_away,
      round(rest_home - rest_away, 0) + 0.0 AS rest_seconds_difference FROM v1""",
    V1_VIEWS,
)
def v1_feature_table(v):
    return _seconds(v1_features(v)).select("match_id", "home_team_id", "away_team_id", *V1_COLS)


@query(
    "v1_mirrored",
    f"""{V1_SQL} SELECT match_id, away_team_id AS home_team_id, home_team_id AS away_team_id, round(-elo_difference, 6) + 0.0 AS elo_difference, round(1 - elo_home_win_prob, 6) AS elo_home_win_prob,
      round(form_away, 6) AS form_home, round(form_home, 6) AS form_away, round(-form_difference, 6) + 0.0 AS form_difference, round(goal_diff_away, 6) + 0.0 AS goal_diff_home FROM v1""",
    V1_VIEWS,
)
def v1_mirrored(v):
    return mirror(v1_features(v), **O.V1_MIRROR).select(
        "match_id", "home_team_id", "away_team_id", "elo_difference", "elo_home_win_prob", "form_home", "form_away",
        "form_difference", "goal_diff_home",
    )


@query("feature_snapshots")
def feature_snapshots(v):
    """Stored snapshots are returned as they are, missing ones are built and hashed."""
    from cutline.operators.ingest import build_or_get, make_snapshots

    ratings = rating_table(v)

    def build(spine):
        wanted = v.spine.join(spine, ["match_id", "cutoff_time"], "left_semi")
        return O.feature_table(
            wanted, results=v.results, ratings=ratings, quotes=v.quotes, availability=v.availability, competitions=v.competitions,
            events=v.shots, event_meta=v.shot_meta, config=CONFIG, quote_order=["quote_seq"],
        )

    finals = build(v.spine.filter(F.col("stage") == "Final").select("match_id", "cutoff_time"))
    # What is stored is read, not built again wherever the missing keys are asked for.
    stored = materialize(make_snapshots(finals, "v1", O.FEATURES), "snapshots")
    return build_or_get(v.spine.select("match_id", "cutoff_time"), stored, build, "v1", O.FEATURES)


@query(
    "explain",
    f"""{BASE}, x AS (SELECT s.match_id, eh.rating - ea.rating AS d, ph_avg / (ph_avg + pa_avg) AS mp,
        coalesce(h.confirmed_out_midfielders, 0) - coalesce(a.confirmed_out_midfielders, 0) AS o FROM spine s {SIDES})
    SELECT match_id, CAST((d > 5)::INTEGER + coalesce((mp > 0.55)::INTEGER, 0) + (o < 0)::INTEGER AS INTEGER) AS n_positive,
      CAST((d < -5)::INTEGER + coalesce((mp < 0.45)::INTEGER, 0) + (o > 0)::INTEGER AS INTEGER) AS n_negative,
      CASE WHEN d > 5 THEN 'elo_difference' WHEN mp > 0.55 THEN 'market_advance_probability' WHEN o < 0 THEN 'confirmed_out_midfielders' END AS first_positive, mp IS NOT NULL AS market_available
    FROM x""",
    VIEWS,
)
def explain(v):
    from cutline.plans.prediction import with_explanation

    e = F.col("explanation")
    return with_explanation(features(v)).select(
        "match_id", F.size(e["top_positive_factors"]).alias("n_positive"), F.size(e["top_negative_factors"]).alias("n_negative"),
        F.get(e["top_positive_factors"], F.lit(0))["feature"].alias("first_positive"),
        e["data_completeness"]["market_available"].alias("market_available"),
    )


@query("coverage_report")
def coverage_report(v):
    from cutline.catalog.labels import classified
    from cutline.operators import aliases as A
    from cutline.operators.quality import coverage_report as report

    reg = A.builtin_registry(v.spark)
    queue = A.unresolved_names(v.raw_names, "raw_name", reg, "customers")
    return report(reg, queue, classified(v), features(v), ["market_available", "events_available", "is_knockout"])


