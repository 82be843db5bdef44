"""Quotes: point-in-time filters and the de-vigged consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import probability as P
from cutline.operators.skew import salted_join

HOME_SELECTIONS = ("home", "home_to_advance")
AWAY_SELECTIONS = ("away", "away_to_advance")


def split_valid_odds(quotes: DataFrame, odds: str = "decimal_odds") -> tuple[DataFrame, DataFrame]:
    ok = P.valid_odds(odds)
    return quotes.filter(ok), quotes.filter(~ok).withColumn("reason", F.lit("odds_not_above_one"))


def quotes_before(quotes: DataFrame, cutoffs: DataFrame, salts: int = 1) -> DataFrame:
    """Quotes with ``captured_at <= cutoff_time`` for each (match, cut-off).

    The rows themselves need no salt: where nothing is grouped behind the join, adaptive execution splits a hot match.
    """
    spine = cutoffs.select("match_id", "cutoff_time").distinct()
    return salted_join(quotes, spine, ["match_id"], salts=salts).filter(
        F.col("captured_at") <= F.col("cutoff_time")
    )


def latest_quotes(
    quotes: DataFrame, cutoffs: DataFrame, order: list[str] | None = None, salts: int = 1
) -> DataFrame:
    """Latest pre-match quote per (match, cut-off, bookmaker, market, selection).

    ``order`` breaks equal capture times (last wins). Match and cut-off are grouped as one struct, which the join's partitions do not serve: quotes are
    combined before they are shuffled again, and adaptive execution can split the join of a hot match, so that the cut-offs need no copies for salts.
    """
    pre = quotes.filter(~F.coalesce(F.col("is_live"), F.lit(False)))
    seen = quotes_before(pre, cutoffs, salts).withColumn("_m", F.struct("match_id", "cutoff_time"))
    by = F.struct("captured_at", *(order or []), "decimal_odds")
    latest = seen.groupBy("_m", "bookmaker", "market_type", "selection").agg(
        F.max_by("decimal_odds", by).alias("decimal_odds"),
        F.max("captured_at").alias("captured_at"),
    )
    return latest.select("_m.*", *[c for c in latest.columns if c != "_m"])


def two_sided_books(latest: DataFrame) -> DataFrame:
    """Bookmakers that quote both sides of a market, one row each."""
    side = F.lower("selection")
    # within one side the later selection name stands, as one book could list both spellings
    home = F.when(side.isin(*HOME_SELECTIONS), F.struct("selection", "decimal_odds"))
    away = F.when(side.isin(*AWAY_SELECTIONS), F.struct("selection", "decimal_odds"))
    return (
        latest.groupBy("match_id", "cutoff_time", "market_type", "bookmaker")
        .agg(F.max(home).alias("h"), F.max(away).alias("a"), F.max("captured_at").alias("captured_at"))
        .withColumns({"home_odds": F.col("h.decimal_odds"), "away_odds": F.col("a.decimal_odds")})
        .drop("h", "a")
    )


def market_consensus(
    quotes: DataFrame,
    cutoffs: DataFrame,
    *,
    min_bookmakers: int = 2,
    prefer_advance: bool = True,
    merge_advance_markets: bool = False,
    allow_fallback: bool = True,
    order: list[str] | None = None,
    salts: int = 1,
) -> DataFrame:
    """One row per (match, cut-off) with a valid two-way market; no row otherwise.

    The market is the alphabetically first one naming ``advance``, else ``moneyline_90``, else the
    first. ``merge_advance_markets`` treats both ``*_to_advance`` names as one market;
    ``allow_fallback=False`` never falls back to a 90-minute market.
    """
    least = max(1, int(min_bookmakers))
    latest = latest_quotes(quotes, cutoffs, order, salts)
    if merge_advance_markets:
        latest = (
            latest.withColumn(
                "market_type",
                F.when(F.contains("market_type", F.lit("advance")), "to_advance").otherwise(
                    F.col("market_type")
                ),
            )
            .groupBy("match_id", "cutoff_time", "bookmaker", "market_type", "selection")
            .agg(
                F.max_by("decimal_odds", F.struct("captured_at", "decimal_odds")).alias("decimal_odds"),
                F.max("captured_at").alias("captured_at"),
            )
        )
    books = two_sided_books(latest)
    both = F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull()
    p_home = P.de_vig_home("home_odds", "away_odds")
    keep = lambda c: F.when(both, c)
    per_market = books.groupBy("match_id", "cutoff_time", "market_type").agg(
        F.count(F.lit(1)).alias("n_quoting"),
        F.count_if(both).alias("bookmaker_count"),
        F.avg(keep(p_home)).alias("avg_home"),
        F.avg(keep(1.0 - p_home)).alias("avg_away"),
        F.stddev_pop(keep(p_home)).alias("dispersion"),
        F.avg(keep(P.implied_probability("home_odds"))).alias("raw_home"),
        F.avg(keep(P.implied_probability("away_odds"))).alias("raw_away"),
        F.max("captured_at").alias("most_recent"),
    )
    market = F.col("market_type")
    rank = F.when(F.contains(market, F.lit("advance")) & F.lit(prefer_advance), 0)
    rank = rank.when(market == "moneyline_90", 1).otherwise(2)
    body = F.struct(
        "market_type", "n_quoting", "bookmaker_count", "avg_home", "avg_away", "dispersion",
        "raw_home", "raw_away",
    )
    chosen = per_market.groupBy("match_id", "cutoff_time").agg(
        F.min_by(body, F.struct(rank.alias("r"), market)).alias("m"),
        F.min(rank).alias("_rank"),
        F.max("most_recent").alias("most_recent_captured_at"),
    )
    if not allow_fallback:
        chosen = chosen.filter(F.col("_rank") == 0)
    total = F.col("m.avg_home") + F.col("m.avg_away")
    return chosen.filter(
        (F.col("m.n_quoting") >= least) & (F.col("m.bookmaker_count") >= least)
    ).select(
        "match_id",
        "cutoff_time",
        F.col("m.market_type").alias("market_type"),
        (F.col("m.avg_home") / total).alias("home_advance_probability"),
        (F.col("m.avg_away") / total).alias("away_advance_probability"),
        F.col("m.bookmaker_count").alias("bookmaker_count"),
        (F.col("m.raw_home") + F.col("m.raw_away") - 1.0).alias("overround"),
        F.col("m.raw_home").alias("raw_home"),
        F.col("m.raw_away").alias("raw_away"),
        F.when(F.col("m.bookmaker_count") > 1, F.col("m.dispersion")).otherwise(0.0).alias("dispersion"),
        "most_recent_captured_at",
    )
