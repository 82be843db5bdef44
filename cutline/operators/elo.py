"""Sequential ratings.

Each update reads the two ratings left by earlier matches. A short history is one ordered scan, Arrow batches with a small entry per
team. A long one is cut into time slices that are scanned side by side, each from a guess of the ratings at its start; the ends of the
earlier slices then give better starts, and slices whose starts moved are scanned again until none moves. Slices forget their
starts quickly (a match shrinks an error by several per cent), so the rounds are few however many slices there are, and never more than
slices. No task holds more than a slice, whoever met whom.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import probability as P
from cutline.functions.timeutil import days_between
from cutline.operators.components import components, components_of_few
from cutline.operators.pit import SLICE_DAYS, Latest, pit_lookup
from cutline.session import checkpoint_dir

MAX_ROWS_PER_TASK = 2_000_000
#: Starts that move by no more than this are settled; ratings of the last round differ from those of one scan by about as much.
SETTLED = 2e-11
#: Slice ends of the teams that one task takes starts from. Groups of teams are drawn by hash; what is lost in one is spread in it.
GROUP_ROWS = 2_000_000
#: Pairs of teams up to which pools are found on the driver.
FEW_PAIRS = 100_000


@dataclass(frozen=True)
class EloConfig:
    initial_rating: float = 1500.0
    base_k_factor: float = 20.0
    k_floor: float = 5.0
    k_ceiling: float = 40.0
    home_advantage: float = 60.0
    time_decay_per_day: float = 0.0
    mov_multiplier: float = 0.0
    tie_resolution: str = "draw_treated_as_50_50"
    # of two matches of a team at the same instant, later look-ups see the first; "last" sees both
    equal_time: str = "first"
    # idle ratings shrink towards this value
    decay_target: float = 0.0


HISTORY_SCHEMA = (
    "slice int, match_key string, team_id string, kickoff_at timestamp, seq long, rating_before double, rating double"
)
HISTORY = ("match_key", "team_id", "kickoff_at", "seq", "rating_before", "rating")
ENDS_SCHEMA = "slice int, team_id string, end double, us long, left double, slope double"


def _scan(cfg: dict, ends: bool = False):
    """Ordered scan over (slice, kickoff, match) batches; state rows come first in each slice. It gives the history, or with ``ends``
    one row per (slice, team): its rating and time after the slice, and of a change of its start the share ``left`` by decay and the
    share ``slope`` left by decay and matches; the rest goes to opponents."""

    def run(batches):
        import numpy as np
        import pandas as pd

        initial, lam, target = cfg["initial_rating"], cfg["time_decay_per_day"], cfg["decay_target"]
        use_mov, keep_first = cfg["mov_multiplier"] > 0, cfg["equal_time"] == "first"
        day_us, per_point = 86400.0 * 1e6, math.log(10.0) / 400.0
        now_in, state, shares, seq = None, {}, {}, 0

        def rating_at(entry, now):
            """Rating, and what decay has left of it."""
            if entry is None:
                return initial, 1.0
            value, since = entry
            if lam > 0 and now > since:
                left = math.exp(-lam * (now - since) / day_us)
                return target + (value - target) * left, left
            return value, 1.0

        def closed():
            rows = [(now_in, team, *state[team], *share) for team, share in shares.items()]
            return pd.DataFrame(rows, columns=["slice", "team_id", "end", "us", "left", "slope"])

        for pdf in batches:
            step_of = pdf["k"] * pdf["mov"] if use_mov else pdf["k"]
            h0, a0, h1, a1 = [], [], [], []
            cols = [c.tolist() for c in (*(pdf[c] for c in ("slice", "us", "home", "away", "score", "edge", "seed")), step_of)]
            for part, us, home, away, score, edge, seed, step in zip(*cols, strict=True):
                if part != now_in:
                    if shares:
                        yield closed()
                    now_in, state, shares = part, {}, {}
                if seed == seed:  # a carried state row, not a match
                    state[home] = (seed, us)
                    continue
                before_h, before_a = state.get(home), state.get(away)
                (rh, lh), (ra, la) = rating_at(before_h, us), rating_at(before_a, us)
                expected = 1.0 / (1.0 + 10.0 ** ((ra - rh - edge) / 400.0))
                nh, na = rh + step * (score - expected), ra + step * ((1.0 - score) - (1.0 - expected))
                own = 1.0 - step * per_point * expected * (1.0 - expected)
                for team, value, left in ((home, nh, lh), (away, na, la)):
                    entry = state.get(team)
                    if keep_first and entry is not None and entry[1] == us:
                        left, slope = 1.0, 1.0
                    else:
                        state[team] = (value, us)
                        slope = left * own
                    if ends:
                        x, y = shares.get(team, (1.0, 1.0))
                        shares[team] = (x * left, y * slope)
                if not ends:
                    h0.append(rh)
                    a0.append(ra)
                    h1.append(nh)
                    a1.append(na)
            if ends:
                continue
            own_rows = pdf[pdf["seed"].isna()]
            n = len(own_rows)
            both = lambda x, y: np.column_stack([x, y]).ravel()
            twice = lambda c: np.repeat(own_rows[c].to_numpy(), 2)
            yield pd.DataFrame({
                "slice": twice("slice"), "match_key": twice("match_key"),
                "team_id": both(own_rows["home"].to_numpy(object), own_rows["away"].to_numpy(object)),
                "kickoff_at": pd.to_datetime(twice("us"), unit="us", utc=True), "seq": np.arange(seq, seq + 2 * n),
                "rating_before": both(np.array(h0, float), np.array(a0, float)), "rating": both(np.array(h1, float), np.array(a1, float)),
            })
            seq += 2 * n
        if shares:
            yield closed()

    return run


def elo_input(
    matches: DataFrame, config: EloConfig, importance: str | None = None, match_id: str = "match_id",
) -> DataFrame:
    """Reduce matches to what the scan needs, all arithmetic that is not sequential done here.

    The label is ``home_advances`` when known, else the 90-minute score (draw 0.5); matches with
    neither are dropped.
    """
    hg, ag = F.col("home_goals_90"), F.col("away_goals_90")
    won = F.col("home_advances")
    score = (
        F.when(won.isNotNull(), won.cast("double"))
        .when(hg > ag, 1.0)
        .when(hg < ag, 0.0)
        .when(hg == ag, 0.5)
    )
    weight = F.coalesce(F.col(importance), F.lit(1.0)) if importance else F.lit(1.0)
    neutral = F.coalesce(F.col("neutral_venue"), F.lit(False))
    return matches.select(
        F.col(match_id).alias("_order"),
        F.col(match_id).cast("string").alias("match_key"),
        F.unix_micros("kickoff_at").alias("us"),
        F.col("home_team_id").alias("home"),
        F.col("away_team_id").alias("away"),
        score.alias("score"),
        F.when(neutral, 0.0).otherwise(config.home_advantage).alias("edge"),
        P.k_factor(weight, config.base_k_factor, config.k_floor, config.k_ceiling).alias("k"),
        P.mov_multiplier(hg, ag).alias("mov"),
        F.lit(float("nan")).alias("seed"),
    ).filter(F.col("score").isNotNull())


def team_pools(rows: DataFrame) -> DataFrame:
    """(team_id, pool) from meetings (home, away): the pool is the smallest team reachable over meetings."""
    pairs = rows.select(F.col("home").alias("a"), F.col("away").alias("b")).distinct()
    found = components_of_few(pairs, FEW_PAIRS)
    return (components(pairs) if found is None else found).select(F.col("node").alias("team_id"), F.col("component").alias("pool"))


def with_pools(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the pool of each row's team, so that parts of a history that never meet can be told apart."""
    named = history.join(team_pools(rows), "team_id", "left").withColumn("pool", F.coalesce("pool", "team_id"))
    return named.select("pool", *HISTORY)


def _scanned(rows: DataFrame, config: EloConfig, slices: int = 1, ends: bool = False) -> DataFrame:
    # A task for each slice: partitions by hash would put several in one, and small ones would be merged.
    # State rows (seed set) sort before the matches of their slice.
    return (
        rows.repartitionById(slices, F.col("slice").cast("int"))
        .sortWithinPartitions("slice", F.isnan("seed"), "us", "_order")
        .drop("_order")
        .mapInPandas(_scan(asdict(config), ends), ENDS_SCHEMA if ends else HISTORY_SCHEMA)
    )


def time_slices(rows: DataFrame, max_rows: int) -> list[int]:
    """Boundaries (epoch us) such that no slice has more than ``max_rows`` rows (a day is never cut).

    The driver sees one number per day of history, nothing that grows with the rows.
    """
    day = F.floor(F.col("us") / F.lit(86400 * 1_000_000)).cast("long")
    bounds, filled = [], 0
    for row in rows.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day").toLocalIterator():
        if filled and filled + row["n"] > max_rows:
            bounds.append(row["day"] * 86400 * 1_000_000)
            filled = 0
        filled += row["n"]
    return bounds


def _starts(initial: float):
    """Start of every slice of a team but its first, from the ends of the slices before.

    A start that has moved since its slice was scanned moves the slice's end by its slope; what the slopes of a slice lose went to opponents
    and is spread over the slice's teams as they meet others. Rows come by (group, slice); a group keeps one entry per team.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        state: dict = {}
        held, here = [], None

        def closed():
            """The starts of the slice that is held, and the ends that follow from them."""
            out, moved = [], []
            for _, part, team, used, _, _, _, _ in held:
                known = state.get(team)
                if known is not None:
                    out.append((part, team, *known, used))
                start = known[0] if known is not None else initial
                moved.append(start - (initial if used != used else used))
            e, left, slope = np.array(moved), np.array([h[6] for h in held]), np.array([h[7] for h in held])
            gone = left - slope
            total = gone.sum()
            e = slope * e + (gone * (gone @ e) / total if total > 0 else 0.0)
            for (_, _, team, _, end, us, _, _), x in zip(held, e.tolist(), strict=True):
                state[team] = (end + x, us)
            return out

        def frame(out):
            return pd.DataFrame(out, columns=["slice", "team_id", "seed", "us", "used"])

        for pdf in batches:
            out = []
            for row in zip(*(pdf[c].tolist() for c in ("group", "slice", "team_id", "used", "end", "us", "left", "slope")), strict=True):
                if row[:2] != here:
                    if held:
                        out += closed()
                    if here is None or row[0] != here[0]:
                        state = {}
                    held, here = [], row[:2]
                held.append(row)
            yield frame(out)
        if held:
            yield frame(closed())

    return run


def sliced_ratings(rows: DataFrame, config: EloConfig, bounds: list[int]) -> tuple[DataFrame, int]:
    """(history, rounds) of prepared rows cut at ``bounds``; all slices of a round run side by side.

    Rounds look for the slices' starts only and write one row per (slice, team); the history is written once, when the starts are
    settled. The driver sees the numbers of the slices to scan again. All tables are stored, so a lost executor repeats slices of one round.
    """
    spark = rows.sparkSession
    base = f"{checkpoint_dir(spark)}/elo-{uuid.uuid4().hex}"
    slices = len(bounds) + 1
    number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("us")))
    rows.withColumn("slice", number).write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")

    def from_starts(part: DataFrame) -> DataFrame:
        if starts is None:
            return part
        carried = starts.select("slice", F.col("team_id").alias("home"), "us", "seed")
        return part.unionByName(carried, allowMissingColumns=True)

    todo, starts, ends = list(range(slices)), None, None
    done = 0
    while todo:
        own = F.col("slice").isin(todo)
        new = _scanned(from_starts(rows).where(own), config, slices, ends=True)
        used = starts.where(own).select("slice", "team_id", F.col("seed").alias("used")) if starts is not None else None
        new = new.join(used, ["slice", "team_id"], "left") if used is not None else new.withColumn("used", F.lit(None).cast("double"))
        if ends is not None:
            new = new.unionByName(ends.where(~own))
        new.write.parquet(f"{base}/ends/{done}")
        ends = spark.read.parquet(f"{base}/ends/{done}")
        groups = 1 + ends.count() // GROUP_ROWS
        order = ends.withColumn("group", F.pmod(F.xxhash64("team_id"), F.lit(groups)))
        order = order.repartition("group").sortWithinPartitions("group", "slice", "team_id")
        schema = "slice int, team_id string, seed double, us long, used double"
        order.mapInPandas(_starts(config.initial_rating), schema).write.parquet(f"{base}/starts/{done}")
        starts = spark.read.parquet(f"{base}/starts/{done}")
        done += 1
        moved = F.col("used").isNull() | F.isnan("used") | (F.abs(F.col("seed") - F.col("used")) > SETTLED)
        todo = sorted(r["slice"] for r in starts.where(moved).select("slice").distinct().collect())
        if done > len(bounds) + 2:
            raise RuntimeError("ratings of time slices did not settle")
    _scanned(from_starts(rows), config, slices).write.parquet(f"{base}/history")
    return spark.read.parquet(f"{base}/history").select("slice", *HISTORY), done


def elo_ratings(
    matches: DataFrame,
    config: EloConfig | None = None,
    *,
    importance: str | None = None,
    match_id: str = "match_id",
    max_rows_per_task: int = MAX_ROWS_PER_TASK,
    pools: bool = True,
) -> DataFrame:
    """Rating history: two rows per match, before and after.

    ``max_rows_per_task`` bounds the input of every task: longer histories run as time slices side by side, in rounds. ``pools`` adds
    the smallest team that a row's team is connected with by meetings.
    """
    cfg = config or EloConfig()
    prepared = elo_input(matches, cfg, importance, match_id)
    bounds = time_slices(prepared, max_rows_per_task)
    if bounds:
        history, _ = sliced_ratings(prepared, cfg, bounds)
    else:
        history = _scanned(prepared.withColumn("slice", F.lit(0)), cfg)
    return with_pools(history, prepared) if pools else history.select(*HISTORY)


#: Columns of the history that look-ups read.
LOOKED_UP = ["team_id", "kickoff_at", "rating", "seq"]


def rating_specs(config: EloConfig, inclusive: bool = True) -> dict[str, Latest]:
    """Rating and its time as of a cut-off, with the tie rule of the scan."""
    first = config.equal_time == "first"
    return {
        name: Latest(F.col(c), (F.col("seq"),), first, inclusive)
        for name, c in (("_rating", "rating"), ("_rated_at", "kickoff_at"))
    }


def rating_column(at: str, config: EloConfig):
    """Looked-up rating with idle decay; the initial rating where there is none."""
    value = F.col("_rating")
    if config.time_decay_per_day > 0:
        age = F.greatest(F.lit(0.0), days_between(at, "_rated_at"))
        factor = F.exp(F.lit(-config.time_decay_per_day) * age)
        value = config.decay_target + (value - config.decay_target) * factor
    return F.coalesce(value, F.lit(config.initial_rating))


def rating_asof(
    history: DataFrame,
    cutoffs: DataFrame,
    config: EloConfig | None = None,
    *,
    keys: list[str] | None = None,
    at: str = "cutoff_time",
    inclusive: bool = True,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """Rating of each (team, cut-off); the initial rating where nothing is known yet."""
    cfg, keys = config or EloConfig(), keys or ["team_id"]
    found = pit_lookup(
        [(history, "kickoff_at", rating_specs(cfg, inclusive))],
        cutoffs, keys=keys, at=at, slice_days=slice_days,
    )
    return found.select(*keys, at, rating_column(at, cfg).alias("rating"))


def elo_probability(
    matches: DataFrame,
    history: DataFrame,
    config: EloConfig | None = None,
    *,
    at: str = "cutoff_time",
    inclusive: bool = True,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """P(home advances) of each match at its cut-off, with both ratings."""
    cfg = config or EloConfig()
    teams = matches.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), at)
    known = rating_asof(history, teams, cfg, at=at, inclusive=inclusive, slice_days=slice_days)
    home = known.select(F.col("team_id").alias("home_team_id"), at, F.col("rating").alias("home_rating"))
    away = known.select(F.col("team_id").alias("away_team_id"), at, F.col("rating").alias("away_rating"))
    edge = F.when(F.coalesce(F.col("neutral_venue"), F.lit(False)), 0.0).otherwise(cfg.home_advantage)
    win = P.expected_score("home_rating", "away_rating", edge)
    return (
        matches.join(home, ["home_team_id", at])
        .join(away, ["away_team_id", at])
        .withColumn("elo_home_win_probability", win)
        .withColumn(
            "elo_home_advance_probability",
            P.advance_probability("elo_home_win_probability", cfg.tie_resolution),
        )
    )


def rating_steps(history: DataFrame) -> DataFrame:
    """Change per row, for audits: sums to zero per match without decay."""
    return history.withColumn("delta", F.col("rating") - F.col("rating_before"))


__all__ = [
    "EloConfig", "LOOKED_UP", "MAX_ROWS_PER_TASK", "elo_input", "elo_probability", "elo_ratings", "rating_asof",
    "rating_column", "rating_specs", "rating_steps", "sliced_ratings", "team_pools", "time_slices", "with_pools",
]
