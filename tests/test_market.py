from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cutline.operators import market as M

SCHEMA = (
    "match_id string, bookmaker string, market_type string, selection string, decimal_odds double, captured_at timestamp, is_live boolean"
)
ADV = "home_to_advance"


def quote(book, sel, odds, at, market=ADV, live=False, match="m1"):
    return (match, book, market, sel, odds, at, live)


@pytest.fixture
def consensus(table):
    def run(quotes, cutoff="2026-06-30T04:00:00", **kw):
        cuts = table([("m1", cutoff)], "match_id string, cutoff_time timestamp")
        got = M.market_consensus(table(quotes, SCHEMA), cuts, **kw).collect()
        return got[0] if got else None

    return run


BASE = [
    quote("BookA", "home", 1.6, "2026-06-29T00:00:00"), quote("BookA", "away", 2.4, "2026-06-29T00:00:00"),
    quote("BookB", "Home", 1.5, "2026-06-29T00:00:00"), quote("BookB", "away_to_advance", 2.6, "2026-06-29T00:00:00"),
]


def test_devigged_mean(consensus):
    r = consensus(BASE)
    p = [(1 / 1.6) / (1 / 1.6 + 1 / 2.4), (1 / 1.5) / (1 / 1.5 + 1 / 2.6)]
    assert r["home_advance_probability"] == pytest.approx(sum(p) / 2)
    assert r["home_advance_probability"] + r["away_advance_probability"] == pytest.approx(1)
    assert r["bookmaker_count"] == 2 and r["dispersion"] == pytest.approx(abs(p[0] - p[1]) / 2)
    assert r["overround"] == pytest.approx((1 / 1.6 + 1 / 1.5) / 2 + (1 / 2.4 + 1 / 2.6) / 2 - 1)


def test_quote_on_the_cutoff_counts_and_later_ones_do_not(consensus):
    on = [*BASE, quote("BookA", "home", 1.55, "2026-06-30T04:00:00"), quote("BookA", "home", 9.0, "2026-07-01T02:30:00")]
    r = consensus(on, min_bookmakers=1)
    assert r["raw_home"] == pytest.approx((1 / 1.55 + 1 / 1.5) / 2)


def test_live_quotes_are_ignored(consensus):
    r = consensus([*BASE, quote("BookA", "home", 9.0, "2026-06-29T10:00:00", live=True)])
    assert r["raw_home"] == pytest.approx((1 / 1.6 + 1 / 1.5) / 2)


def test_no_two_way_market_gives_no_row(consensus):
    assert consensus([BASE[0], BASE[2]]) is None
    assert consensus(BASE[:2], min_bookmakers=2) is None
    assert consensus(BASE[:2], min_bookmakers=1)["dispersion"] == 0.0
    assert consensus([]) is None


def test_advance_market_is_preferred_and_fallback_is_optional(consensus):
    ml = [quote(q[1], q[3], 3.0, "2026-06-28T00:00:00", market="moneyline_90") for q in BASE]
    assert consensus([*BASE, *ml])["market_type"] == ADV
    assert consensus([*BASE, *ml], prefer_advance=False)["market_type"] == "moneyline_90"
    assert consensus(ml)["market_type"] == "moneyline_90"
    assert consensus(ml, allow_fallback=False) is None


def test_split_advance_markets_can_be_merged(consensus):
    split = [
        quote(b, s, o, "2026-06-29T00:00:00", market=m)
        for b in ("A", "B") for s, o, m in (("home", 1.6, "home_to_advance"), ("away", 2.4, "away_to_advance"))
    ]
    assert consensus(split) is None
    assert consensus(split, merge_advance_markets=True)["bookmaker_count"] == 2


def test_hot_match_gives_the_same_rows(spark, table):
    """One match holds almost all quotes; the salt must not change the answer."""
    q = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("m"), F.col("id") % 7)).otherwise("hot").alias("match_id"),
        F.concat(F.lit("b"), F.col("id") % 4).alias("bookmaker"), F.lit(ADV).alias("market_type"),
        F.when(F.floor(F.col("id") / 4) % 2 == 0, "home").otherwise("away").alias("selection"),
        (1.2 + (F.col("id") % 37) / 10).alias("decimal_odds"),
        F.timestamp_seconds(1_500_000_000 + F.col("id") * 60).alias("captured_at"), F.lit(False).alias("is_live"), "id",
    )
    cuts = q.select("match_id").distinct().withColumn("cutoff_time", F.timestamp_seconds(F.lit(1_500_100_000)))
    show = lambda salts: sorted(map(str, M.market_consensus(q, cuts, order=["id"], salts=salts).collect()))
    assert show(1) == show(16) and len(show(1)) > 1


def test_invalid_odds_are_split_off(table):
    good, bad = M.split_valid_odds(table([quote("A", "home", 1.0, "2026-01-01"), quote("A", "home", 1.01, "2026-01-01")], SCHEMA))
    assert good.count() == 1 and bad.first()["reason"] == "odds_not_above_one"
