"""Deterministic text and lookup rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.names import _col, is_blank

# Fixed values.
ROLE_BUCKETS = ("goalkeeper", "defender", "midfielder", "attacker")
AVAILABILITY_STATUSES = (
    "available", "questionable", "doubtful", "suspended", "confirmed_out", "lineup_confirmed",
    "unknown",
)
OUT_STATUSES = ("confirmed_out", "suspended")
TRUSTED_HOSTS = ("reuters", "apnews", "bbc", "uefa.com", "fifa.com")
SOCIAL_HOSTS = ("twitter", "x.com", "reddit")
EXCERPT_LENGTH = 200


def role_bucket(role: Column | str) -> Column:
    """First bucket name contained in the role; null when none is."""
    text = F.lower(F.coalesce(_col(role), F.lit("unknown")))
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for bucket in ROLE_BUCKETS:
        expr = expr.when(F.contains(text, F.lit(bucket)), F.lit(bucket))
    return expr


def availability_status_of(text: Column | str) -> Column:
    t = F.lower(_col(text))
    has = lambda word: F.contains(t, F.lit(word))
    return (
        F.when(has("out") & has("confirmed"), "confirmed_out")
        .when(has("doubt"), "doubtful")
        .when(has("lineup") & has("confirmed"), "lineup_confirmed")
        .otherwise("available")
    )


def excerpt(text: Column | str) -> Column:
    return F.substring(_col(text), 1, EXCERPT_LENGTH)


def published_before(observed: Column | str, cutoff: Column | str) -> Column:
    """Strictly before the cut-off; a missing time is never before."""
    return F.coalesce(_col(observed) < _col(cutoff), F.lit(False))


def timestamp_warning(observed: Column | str) -> Column:
    return F.when(_col(observed).isNull(), "Missing observed_at")


def source_reliability(url: Column | str) -> Column:
    t = F.lower(F.coalesce(_col(url), F.lit("")))
    literal = lambda hosts: "|".join(h.replace(".", r"\.") for h in hosts)
    return (
        F.when(t.rlike(literal(TRUSTED_HOSTS)), 0.9)
        .when(t.rlike(literal(SOCIAL_HOSTS)), 0.3)
        .otherwise(0.5)
    )


def source_scored(url: Column | str) -> Column:
    return ~is_blank(url)


def explain(
    elo_difference: Column | str,
    market: Column | str,
    out_midfielders_diff: Column | str,
    lineup_confirmed: Column | str,
    events_available: Column | str,
) -> Column:
    """Bounded factual explanation: factor lists and completeness flags as one struct."""
    elo, mkt, out = _col(elo_difference), _col(market), _col(out_midfielders_diff)

    def factor(cond: Column, feature: str, effect: str) -> Column:
        return F.when(cond, F.struct(F.lit(feature).alias("feature"), F.lit(effect).alias("effect")))

    positive = F.array_compact(F.array(
        factor(elo > 5, "elo_difference", "favors_home"),
        factor(mkt > 0.55, "market_advance_probability", "favors_home"),
        factor(out < 0, "confirmed_out_midfielders", "favors_home"),
    ))
    negative = F.array_compact(F.array(
        factor(elo < -5, "elo_difference", "favors_away"),
        factor(mkt < 0.45, "market_advance_probability", "favors_away"),
        factor(out > 0, "confirmed_out_midfielders", "favors_away"),
    ))
    completeness = F.struct(
        mkt.isNotNull().alias("market_available"),
        F.coalesce(_col(lineup_confirmed).cast("boolean"), F.lit(False)).alias("lineups_confirmed"),
        F.coalesce(_col(events_available).cast("boolean"), F.lit(False)).alias("xg_features_available"),
    )
    return F.struct(
        positive.alias("top_positive_factors"),
        negative.alias("top_negative_factors"),
        completeness.alias("data_completeness"),
    )
