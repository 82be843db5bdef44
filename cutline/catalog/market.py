"""Quote and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.functions import probability as P
from cutline.operators import market as M

REGISTRY = Registry()
query = REGISTRY.query

LATEST = """latest AS (
  SELECT q.match_id, c.cutoff_time, bookmaker, market_type, selection,
    arg_max(decimal_odds, (captured_at, quote_seq, decimal_odds)) AS decimal_odds, max(captured_at) AS captured_at
  FROM quotes q JOIN {spine} c ON c.match_id = q.match_id
  WHERE NOT is_live AND captured_at <= c.cutoff_time GROUP BY ALL)"""

CONSENSUS = LATEST + """,
books AS (
  SELECT match_id, cutoff_time, market_type, bookmaker,
    max(decimal_odds) FILTER (lower(selection) IN ('home', 'home_to_advance')) AS ho,
    max(decimal_odds) FILTER (lower(selection) IN ('away', 'away_to_advance')) AS ao
  FROM latest GROUP BY ALL),
choice AS (
  SELECT match_id, cutoff_time, max(captured_at) AS most_recent_captured_at, coalesce(
    min(market_type) FILTER (market_type LIKE '%advance%'),
    min(market_type) FILTER (market_type = 'moneyline_90'), min(market_type)) AS market_type
  FROM latest GROUP BY ALL),
two AS (
  SELECT b.*, (1 / ho) / (1 / ho + 1 / ao) AS ph FROM books b
  JOIN choice c USING (match_id, cutoff_time, market_type)),
consensus AS (
  SELECT match_id, cutoff_time, market_type,
    avg(ph) FILTER (ph IS NOT NULL) AS ph_avg, avg(1 - ph) FILTER (ph IS NOT NULL) AS pa_avg,
    count(ph) AS bookmaker_count, avg(1 / ho) FILTER (ph IS NOT NULL) AS raw_home,
    avg(1 / ao) FILTER (ph IS NOT NULL) AS raw_away,
    CASE WHEN count(ph) > 1 THEN stddev_pop(ph) ELSE 0 END AS dispersion
  FROM two GROUP BY ALL HAVING count(*) >= {least} AND count(ph) >= {least})"""

CONSENSUS_SELECT = """
SELECT c.match_id, c.cutoff_time, c.market_type, round(ph_avg / (ph_avg + pa_avg), 6) AS home_advance_probability,
  round(pa_avg / (ph_avg + pa_avg), 6) AS away_advance_probability, bookmaker_count,
  round(raw_home + raw_away - 1, 6) AS overround, round(raw_home, 6) AS raw_home, round(raw_away, 6) AS raw_away,
  round(dispersion, 6) AS dispersion, most_recent_captured_at
FROM consensus c JOIN choice USING (match_id, cutoff_time)"""


@query(
    "market_consensus",
    f"WITH {CONSENSUS.format(spine='cutoffs', least=2)} {CONSENSUS_SELECT}",
    ("quotes", "cutoffs"),
)
def market_consensus(v):
    return M.market_consensus(v.quotes, v.cutoffs, min_bookmakers=2, order=["quote_seq"])


@query(
    "market_consensus_at_cutoff",
    f"WITH {CONSENSUS.format(spine='spine', least=1)} {CONSENSUS_SELECT}",
    ("quotes", "spine"),
)
def market_consensus_at_cutoff(v):
    return M.market_consensus(v.quotes, v.spine, min_bookmakers=1, order=["quote_seq"])


@query(
    "latest_quotes",
    f"WITH {LATEST.format(spine='cutoffs')} SELECT * REPLACE (round(decimal_odds, 6) AS decimal_odds) FROM latest",
    ("quotes", "cutoffs"),
)
def latest_quotes(v):
    return M.latest_quotes(v.quotes, v.cutoffs, ["quote_seq"])


@query(
    "odds_before",
    """SELECT match_id, bookmaker, market_type, selection, round(decimal_odds, 6) AS decimal_odds, captured_at, quote_seq, cutoff_time
    FROM quotes JOIN spine s USING (match_id) WHERE captured_at <= cutoff_time""",
    ("quotes", "spine"),
)
def odds_before(v):
    return M.quotes_before(v.quotes, v.spine).select(
        "match_id", "bookmaker", "market_type", "selection", "decimal_odds", "captured_at", "quote_seq", "cutoff_time"
    )


@query(
    "two_sided_books",
    f"""WITH {LATEST.format(spine='cutoffs')}
    SELECT match_id, market_type, bookmaker,
      round(max(decimal_odds) FILTER (selection = 'Home'), 6) AS home_odds,
      round(max(decimal_odds) FILTER (selection = 'away_to_advance'), 6) AS away_odds
    FROM latest GROUP BY ALL
    HAVING count(*) FILTER (selection = 'Home') > 0 AND count(*) FILTER (selection = 'away_to_advance') > 0""",
    ("quotes", "cutoffs"),
)
def two_sided_books(v):
    books = M.two_sided_books(M.latest_quotes(v.quotes, v.cutoffs, ["quote_seq"]))
    return books.filter(F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull()).select(
        "match_id", "market_type", "bookmaker", "home_odds", "away_odds"
    )


@query(
    "implied_probability",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity / 10 > 1 THEN round(1 / (l_quantity / 10), 6) END AS implied,
      coalesce(l_quantity / 10 > 1, false) AS valid FROM lineitem""",
)
def implied_probability(v):
    odds = F.col("l_quantity") / 10
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        P.implied_probability(odds).alias("implied"), P.valid_odds(odds).alias("valid"),
    )


@query(
    "de_vig_two_way",
    """SELECT match_id, bookmaker, quote_seq, round((1 / h) / (1 / h + 1 / a), 6) AS p_home, round((1 / a) / (1 / h + 1 / a), 6) AS p_away
    FROM (SELECT match_id, bookmaker, quote_seq, decimal_odds AS h, 1.07::DOUBLE + (quote_seq % 37) / 9.0::DOUBLE AS a FROM quotes)""",
    ("quotes",),
)
def de_vig_two_way(v):
    q = v.quotes.withColumn("a", 1.07 + (F.col("quote_seq") % 37) / 9.0)
    p = P.de_vig_home("decimal_odds", "a")
    return q.select("match_id", "bookmaker", "quote_seq", p.alias("p_home"), (1.0 - p).alias("p_away"))
