"""Result labels: scores, advancers, shootouts and cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.names import canonical_key, is_blank, trim_all
from cutline.operators.aliases import resolve_teams
from cutline.operators.skew import pick_row


def match_results(matches: DataFrame) -> DataFrame:
    """Result rows from parsed matches.

    No row without both 90-minute scores, nor for a draw without a named advancer; a named
    advancer wins over the score.
    """
    home, away, adv = F.col("home_team_id"), F.col("away_team_id"), F.col("advancing_team_id")
    hg, ag = F.col("home_goals"), F.col("away_goals")
    ft_winner = F.when(hg > ag, home).when(hg < ag, away)
    return (
        matches.filter(hg.isNotNull() & ag.isNotNull())
        .withColumn("home_advances", F.coalesce(adv, ft_winner) == home)
        .filter(F.col("home_advances").isNotNull())
        .select(
            "match_id",
            F.lit("final").alias("final_status"),
            hg.alias("home_goals_90"),
            ag.alias("away_goals_90"),
            "home_advances",
            F.col("kickoff_at").alias("result_verified_at"),
        )
    )


def clean_shootouts(shootouts: DataFrame) -> DataFrame:
    """Complete shootouts keyed by (date, home key, away key); the last of a key stands."""
    t = shootouts.select(
        trim_all("date").alias("date"),
        canonical_key("home_team").alias("home_key"),
        canonical_key("away_team").alias("away_key"),
        trim_all("winner").alias("winner"),
        "ordinal",
        *[trim_all(c).alias(f"_{c}") for c in ("home_team", "away_team")],
    )
    complete = t.filter(
        ~is_blank("date") & ~is_blank("_home_team") & ~is_blank("_away_team") & ~is_blank("winner")
    ).drop("_home_team", "_away_team")
    return pick_row(complete, ["date", "home_key", "away_key"], [F.col("ordinal")]).drop("ordinal")


def results_with_shootouts(results: DataFrame, shootouts: DataFrame, registry: DataFrame) -> DataFrame:
    """Labelled results; a drawn match needs a shootout row.

    ``results``: match_id, kickoff_at, raw_date, home_team, away_team, home_team_id, home_goals,
    away_goals. ``shootouts``: date, home_team, away_team, winner, ordinal.
    """
    so = resolve_teams(clean_shootouts(shootouts), {"winner": "winner_id"}, registry).select(
        F.col("date").alias("_d"), F.col("home_key").alias("_h"), F.col("away_key").alias("_a"), "winner_id"
    )
    r = (
        results.filter(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
        .withColumn("_drawn", F.col("home_goals") == F.col("away_goals"))
        .withColumns({"_d": F.col("raw_date"), "_h": canonical_key("home_team"), "_a": canonical_key("away_team")})
    )
    label = F.when(F.col("_drawn"), F.col("winner_id") == F.col("home_team_id")).otherwise(
        F.col("home_goals") > F.col("away_goals")
    )
    return (
        r.join(so, ["_d", "_h", "_a"], "left")
        .withColumn("home_advances", label)
        .filter(F.col("home_advances").isNotNull())
        .select(
            "match_id",
            F.col("home_goals").alias("home_goals_90"),
            F.col("away_goals").alias("away_goals_90"),
            "home_advances",
            F.col("kickoff_at").alias("result_verified_at"),
        )
    )


def winner_flag(winner: str = "winner") -> Column:
    """True/false for an explicit winner 1/2 (number or text); null otherwise."""
    w = trim_all(F.col(winner).cast("string"))
    return F.when(w == "1", True).when(w == "2", False)


def advancer(reconcile: bool = False) -> Column:
    """Does the home side advance? Null = cannot be told.

    Ladder: explicit winner, full-time winner, penalties, extra time when it differs from full
    time. ``reconcile`` is the report's ladder: penalties, winner, full time; extra time ignored.
    """
    h, a = F.col("home_goals"), F.col("away_goals")
    eh, ea = F.col("home_goals_et"), F.col("away_goals_et")
    ph, pa = F.col("penalties_home"), F.col("penalties_away")
    explicit = winner_flag()
    pens_known = ph.isNotNull() & pa.isNotNull()
    if reconcile:
        return (
            F.when(pens_known, F.when(ph != pa, ph > pa))
            .when(explicit.isNotNull(), explicit)
            .when(h != a, h > a)
        )
    et_used = eh.isNotNull() & ea.isNotNull() & ((eh != h) | (ea != a))
    return (
        F.when(h.isNull() | a.isNull(), F.lit(None).cast("boolean"))
        .when(explicit.isNotNull(), explicit)
        .when(h != a, h > a)
        .when(pens_known, F.when(ph != pa, ph > pa))
        .when(et_used & (eh != ea), eh > ea)
    )


def advancer_reason() -> Column:
    """Why :func:`advancer` is null; null where it is not."""
    h, a = F.col("home_goals"), F.col("away_goals")
    eh, ea = F.col("home_goals_et"), F.col("away_goals_et")
    ph, pa = F.col("penalties_home"), F.col("penalties_away")
    return (
        F.when(advancer().isNotNull(), F.lit(None).cast("string"))
        .when(h.isNull() | a.isNull(), "missing_scores")
        .when(ph.isNotNull() & pa.isNotNull(), "tied_penalties")
        .when(eh.isNotNull() & ea.isNotNull() & ((eh != h) | (ea != a)), "tied_extra_time")
        .otherwise("drawn_without_advancer")
    )


def penalty_cross_check(matches: DataFrame, shootouts: DataFrame) -> DataFrame:
    """Compare penalty winners of two sources, one row per drawn match with penalties.

    ``matches``: date, home_team, away_team, home_goals, away_goals, penalties_home,
    penalties_away. Outcome: agree, disagree or no_shootout_row.
    """
    so = pick_row(
        shootouts.select(
            trim_all("date").alias("date"),
            F.lower(trim_all("home_team")).alias("_h"),
            F.lower(trim_all("away_team")).alias("_a"),
            F.lower(trim_all("winner")).alias("shootout_winner"),
            "ordinal",
        ),
        ["date", "_h", "_a"],
        [F.col("ordinal")],
    ).drop("ordinal").withColumn("_found", F.lit(True))
    m = matches.filter(
        (F.col("home_goals") == F.col("away_goals"))
        & F.col("penalties_home").isNotNull()
        & F.col("penalties_away").isNotNull()
    ).withColumns({"_h": F.lower("home_team"), "_a": F.lower("away_team")})
    by_score = F.when(F.col("penalties_home") > F.col("penalties_away"), F.col("_h")).otherwise(F.col("_a"))
    outcome = (
        F.when(F.col("_found").isNull(), "no_shootout_row")
        .when(F.col("shootout_winner") == by_score, "agree")
        .otherwise("disagree")
    )
    return m.join(so, ["date", "_h", "_a"], "left").withColumn("outcome", outcome).drop("_h", "_a", "_found")


def cross_check_summary(details: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return details.agg(
        F.count_if(o.isin("agree", "disagree")).alias("n_compared"),
        F.count_if(o == "agree").alias("n_agree"),
        F.count_if(o == "disagree").alias("n_disagree"),
        F.count_if(o == "no_shootout_row").alias("n_missing"),
    )


def unmatched_shootouts(shootouts: DataFrame, matches: DataFrame) -> DataFrame:
    """Shootouts whose (date, home, away) text occurs in no match."""
    on = ["date", "home_team", "away_team"]
    return shootouts.join(matches.select(*on), on, "left_anti")
