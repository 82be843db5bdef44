"""Team histories, decayed form, rest days and last-N look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import probability as P
from cutline.functions.timeutil import days_between, epoch_days
from cutline.operators.pit import SLICE_DAYS, Latest, Total, pit_lookup, sliced_rank

DEFAULT_REST_DAYS = 7
FORM_HALF_LIFE = 180.0
V1_HALF_LIFE = 365.0
# weights are 2^((t - anchor)/half_life); the anchor cancels in every mean
ANCHOR_DAY = 10957.0  # 2000-01-01
ONE_ANCHOR = 30.0  # from this half life on, one anchor keeps every exponent within double range for 80 years
ERA = 100  # half lives; a shorter half life has an anchor per era


def team_rows(results: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Two rows per match, one per side, with goals swapped for the away side."""
    keep = ["match_id", "kickoff_at", *(carry or [])]

    def side(team: str, opponent: str, gf: str, ga: str, advances: Column, home: bool) -> Column:
        return F.struct(
            F.col(team).alias("team_id"),
            F.col(opponent).alias("opponent_id"),
            F.col(gf).alias("goals_for"),
            F.col(ga).alias("goals_against"),
            advances.alias("advances"),
            F.lit(home).alias("is_home"),
        )

    won = F.col("home_advances")
    rows = F.array(
        side("home_team_id", "away_team_id", "home_goals_90", "away_goals_90", won, True),
        side("away_team_id", "home_team_id", "away_goals_90", "home_goals_90", ~won, False),
    )
    return results.select(*keep, F.explode(rows).alias("s")).select(*keep, "s.*")


def result_points(gf: str = "goals_for", ga: str = "goals_against") -> Column:
    """3 for a win, 1 for a draw, 0 for a loss over 90 minutes."""
    return F.when(F.col(gf) > F.col(ga), 3.0).when(F.col(gf) == F.col(ga), 1.0).otherwise(0.0)


def form_specs(half_life_days: float) -> dict[str, Latest | Total]:
    """Running sums whose ratios are the decayed means at any later cut-off.

    With w = 2^((t - c)/hl) the factor 2^(-c/hl) cancels in sum(w*x)/sum(w).
    """
    if 0 < half_life_days < ONE_ANCHOR:
        raise ValueError("a half life this short needs an anchor per era: see decayed_form")
    scored = is_scored()
    weight = (
        F.lit(1.0)
        if half_life_days <= 0
        else F.pow(F.lit(2.0), (epoch_days("kickoff_at") - ANCHOR_DAY) / half_life_days)
    )
    w = F.when(scored, weight)
    return {
        "_w": Total(w),
        "_wp": Total(w * result_points()),
        "_wg": Total(w * (F.col("goals_for") - F.col("goals_against"))),
        "last_match_at": Latest(F.when(scored, F.col("kickoff_at"))),
    }


def form_columns(at: str) -> dict[str, Column]:
    mean = lambda x: F.when(F.col("_w") > 0, F.col(x) / F.col("_w")).otherwise(0.0)
    return {
        "weighted_points": mean("_wp"),
        "weighted_goal_difference": mean("_wg"),
        "rest_days": rest_days(at, "last_match_at"),
    }


def rest_days(cutoff: str, last_match: str, default: int = DEFAULT_REST_DAYS) -> Column:
    """Whole days from the last match to the cut-off, never negative."""
    whole = F.floor(days_between(cutoff, last_match)).cast("int")
    return F.when(whole >= 0, whole).when(whole < 0, 0).otherwise(default)


def rest_days_v1(kickoff: str, last_match: str) -> Column:
    """Fractional days from the last match to kickoff."""
    return F.coalesce(days_between(kickoff, last_match), F.lit(float(DEFAULT_REST_DAYS)))


def decayed_form(
    history: DataFrame,
    cutoffs: DataFrame,
    *,
    half_life_days: float = FORM_HALF_LIFE,
    at: str = "cutoff_time",
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """Decayed points, goal difference and rest days per (team, cut-off), strictly before it."""
    if 0 < half_life_days < ONE_ANCHOR:
        return _form_by_era(history, cutoffs, half_life_days, at, slice_days)
    looked = pit_lookup(
        [(history, "kickoff_at", form_specs(half_life_days))],
        cutoffs,
        keys=["team_id"],
        at=at,
        slice_days=slice_days,
    )
    return looked.withColumns(form_columns(at)).drop("_w", "_wp", "_wg")


def _form_by_era(history: DataFrame, cutoffs: DataFrame, half_life_days: float, at: str, slice_days: float | None) -> DataFrame:
    """The same sums for any half life: weights count from the start of an era of 100 half lives. What came before a
    cut-off's era is one carried row per team, that of the latest era with a match and the one before it; older matches weigh less
    than 2^-100 of these, below the precision of a double."""
    days = ERA * half_life_days
    era = lambda ts: F.floor(epoch_days(ts) / days)
    border = lambda e: F.timestamp_micros((e * (days * 86_400_000_000.0)).cast("long"))
    rows = history.where(is_scored()).withColumn("_era", era("kickoff_at"))
    w = F.pow(F.lit(2.0), (epoch_days("kickoff_at") - F.col("_era") * days) / half_life_days)
    parts = {"_w": w, "_wp": w * result_points(), "_wg": w * (F.col("goals_for") - F.col("goals_against"))}
    asked = cutoffs.select("team_id", at).distinct().withColumn("_era", era(at))
    specs = {**{k: Total(x) for k, x in parts.items()}, "last_match_at": Latest(F.col("kickoff_at"))}
    own = pit_lookup([(rows, "kickoff_at", specs)], asked, keys=["team_id", "_era"], at=at, slice_days=slice_days)
    total = rows.groupBy("team_id", "_era").agg(*[F.sum(x).alias(k) for k, x in parts.items()], F.max("kickoff_at").alias("last"))
    older = total.select("team_id", (F.col("_era") + 1).alias("_era"), *[F.col(k).alias(f"{k}0") for k in parts])
    carried = total.join(older, ["team_id", "_era"], "left").select(
        "team_id", border(F.col("_era") + 1).alias("_end"),
        F.struct("_era", *[(F.col(k) + F.coalesce(F.col(f"{k}0"), F.lit(0.0)) * 2.0**-ERA).alias(k) for k in parts], "last").alias("_c"),
    )
    starts = own.select("team_id", border(F.col("_era")).alias("_start"))
    before = pit_lookup([(carried, "_end", {"_before": Latest(F.col("_c"), inclusive=True)})], starts, keys=["team_id"], at="_start", slice_days=slice_days)
    both = own.withColumn("_start", border(F.col("_era"))).join(before, ["team_id", "_start"], "left")
    c, factor = F.col("_before"), F.pow(F.lit(2.0), (F.col("_before")["_era"] - F.col("_era")) * float(ERA))
    none = F.col("_w").isNull()
    summed = both.select(
        "team_id", at, *[F.when(none, c[k]).otherwise(F.col(k) + F.coalesce(c[k] * factor, F.lit(0.0))).alias(k) for k in parts],
        F.coalesce("last_match_at", c["last"]).alias("last_match_at"),
    )
    return summed.withColumns(form_columns(at)).drop(*parts)


def is_scored() -> Column:
    return F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull()


def ranked_history(
    history: DataFrame, slice_days: float | None = SLICE_DAYS, counts: dict[str, Column] | None = None
) -> DataFrame:
    """Number each team's matches in time; of equal times the smaller id counts as more recent."""
    return sliced_rank(
        history,
        keys=["team_id"],
        ts="kickoff_at",
        order=[F.col("kickoff_at"), F.col("match_id").desc()],
        out="rank",
        counts=counts,
        slice_days=slice_days,
    )


def rank_window(k: Column, n: int) -> Column:
    """Ranks of the newest ``n`` of ``k`` rows; null when there are none."""
    return F.when(k > 0, F.sequence(F.greatest(F.lit(1), k - (n - 1)), k))


def last_n(
    history: DataFrame,
    cutoffs: DataFrame,
    n: int,
    *,
    at: str = "cutoff_time",
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """The newest ``n`` rows strictly before each (team, cut-off); exactly those rows.

    The cut-off is turned into a rank, then an equi-join on (team, rank) fetches at most ``n``
    rows: the fan-out is bounded by the operator itself.
    """
    ranked = ranked_history(history, slice_days)
    counts = pit_lookup(
        [(history, "kickoff_at", {"k": Total(F.lit(1))})],
        cutoffs,
        keys=["team_id"],
        at=at,
        slice_days=slice_days,
    )
    wanted = counts.select("team_id", at, "k", F.explode(rank_window(F.col("k"), n)).alias("rank"))
    return wanted.join(ranked, ["team_id", "rank"]).withColumn(
        "recency", F.col("k") - F.col("rank") + 1
    ).drop("k", "rank")


def v1_points() -> Column:
    """3 to the side that advanced, else 1 when the 90 minutes were drawn, else 0."""
    drawn = F.col("goals_for").eqNullSafe(F.col("goals_against"))
    return F.when(F.col("advances"), 3.0).when(drawn, 1.0).otherwise(0.0)


def opponent_weighted_form(
    history: DataFrame,
    asks: DataFrame,
    *,
    n: int = 5,
    half_life_days: float = V1_HALF_LIFE,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """Mean points of the last ``n`` matches, weighted by decay times opponent rating.

    ``asks``: (team_id, cutoff_time, opponent_id, opponent_rating). A past opponent counts with
    ``opponent_rating`` if it is the coming opponent, else with 1500.
    """
    past = last_n(history, asks.select("team_id", "cutoff_time"), n, slice_days=slice_days).select(
        "team_id", "cutoff_time", "kickoff_at", F.col("opponent_id").alias("past_opponent"),
        v1_points().alias("points"),
    )
    strength = F.when(F.col("past_opponent") == F.col("opponent_id"), F.col("opponent_rating")).otherwise(1500.0)
    w = P.decay(days_between("cutoff_time", "kickoff_at"), half_life_days, True) * strength
    return (
        asks.join(past, ["team_id", "cutoff_time"], "left")
        .groupBy("team_id", "cutoff_time", "opponent_id", "opponent_rating")
        .agg(F.sum(w).alias("_w"), F.sum(w * F.col("points")).alias("_wp"))
        .withColumn("form", F.when(F.col("_w") != 0, F.col("_wp") / F.col("_w")).otherwise(0.0))
        .drop("_w", "_wp")
    )


def decayed_goal_diff(
    history: DataFrame,
    cutoffs: DataFrame,
    *,
    n: int = 8,
    half_life_days: float = V1_HALF_LIFE,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """Decayed goal difference of the last ``n`` scored matches per (team, cut-off)."""
    scored = history.filter(is_scored())
    spine = cutoffs.select("team_id", "cutoff_time").distinct()
    past = last_n(scored, spine, n, slice_days=slice_days)
    w = P.decay(days_between("cutoff_time", "kickoff_at"), half_life_days, True)
    diff = F.col("goals_for") - F.col("goals_against")
    means = past.groupBy("team_id", "cutoff_time").agg((F.sum(w * diff) / F.sum(w)).alias("goal_diff"))
    return spine.join(means, ["team_id", "cutoff_time"], "left").withColumn(
        "goal_diff", F.coalesce("goal_diff", F.lit(0.0))
    )
