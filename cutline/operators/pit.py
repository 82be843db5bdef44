"""Point-in-time look-ups: the value known for a key at, or strictly before, a cut-off.

One primitive serves latest-value (as-of), running sum and running count. History and cut-offs
are merged into one row per (key, time), so no theta join and no fan-out occurs. Each key is cut
into fixed time slices: a window runs inside one slice only, and what earlier slices contribute
is carried over from one summary row per (key, slice). A key with a third of all rows is
therefore spread over as many tasks as it has slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DAYS = 90


@dataclass(frozen=True)
class Latest:
    """Latest non-null value; ``order`` breaks equal times, ``first`` keeps the first of them.

    Without ``order`` equal times give the largest value. Plain numbers and times as value and a
    single order column keep the aggregation in the hash path.
    """

    value: Column
    order: tuple[Column, ...] = ()
    first: bool = False
    inclusive: bool = False


@dataclass(frozen=True)
class Total:
    """Running sum of ``value`` over earlier rows; null when there is none."""

    value: Column
    inclusive: bool = False


def slice_id(ts: Column, days: float | None) -> Column:
    if not days:
        return F.lit(0).cast("long")
    return F.floor(F.unix_seconds(ts) / F.lit(int(days * 86400))).cast("long")


def history_of(df: DataFrame, keys: list[str], ts: str, specs: dict[str, Latest | Total]) -> DataFrame:
    """Project a history to the columns the look-up needs (early pruning)."""
    cols = [F.col(k) for k in keys] + [F.col(ts).alias("_ts")]
    for name, spec in specs.items():
        cols.append(spec.value.alias(f"_v_{name}"))
        if isinstance(spec, Latest) and spec.order:
            order = spec.order[0] if len(spec.order) == 1 else F.struct(*spec.order)
            cols.append(F.when(spec.value.isNotNull(), order).alias(f"_o_{name}"))
    return df.select(*cols)


def pit_lookup(
    sources: list[tuple[DataFrame, str, dict[str, Latest | Total]]],
    cutoffs: DataFrame,
    *,
    keys: list[str],
    at: str,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """Look up every spec at each distinct (keys, at).

    ``sources`` lists (history, time column, {output: spec}); all of them share one shuffle.
    Returns (keys, at, outputs): the caller joins it back, so repeated cut-offs cost nothing.
    """
    specs: dict[str, Latest | Total] = {}
    parts = [cutoffs.select(*keys, F.col(at).alias("_ts"), F.lit(True).alias("_q"))]
    for df, ts, own in sources:
        if specs.keys() & own.keys():
            raise ValueError("output names must differ between sources")
        specs.update(own)
        parts.append(history_of(df, keys, ts, own))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    # Key and slice travel as one struct, which is never null: the join below then adds no null filter to one of its two
    # branches, and both read one shuffle of the points.
    key = F.struct(*keys, slice_id(F.col("_ts"), slice_days).alias("_slice")).alias("_k")
    merged = merged.select(key, *[c for c in merged.columns if c not in keys])
    named = [F.col(f"_k.{k}").alias(k) for k in keys]

    # one row per (key, time): copies are combined before the shuffle
    aggs = [F.max("_q").alias("_q")]
    for name, spec in specs.items():
        v = F.col(f"_v_{name}")
        if isinstance(spec, Latest) and not spec.order:
            aggs.append(F.max(v).alias(f"_v_{name}"))
        elif isinstance(spec, Latest):
            pick = F.min_by if spec.first else F.max_by
            aggs.append(pick(v, F.col(f"_o_{name}")).alias(f"_v_{name}"))
        else:
            aggs.append(F.sum(v).alias(f"_v_{name}"))
    points = merged.groupBy("_k", "_ts").agg(*aggs)

    before, upto = Window.unboundedPreceding, Window.currentRow
    in_slice = Window.partitionBy("_k").orderBy("_ts")
    outs = []
    for name, spec in specs.items():
        frame = in_slice.rowsBetween(before, upto if spec.inclusive else -1)
        v = F.col(f"_v_{name}")
        run = F.last(v, True) if isinstance(spec, Latest) else F.sum(v)
        outs.append(run.over(frame).alias(name))
    if not slice_days:
        local = points.select(*named, F.col("_ts").alias(at), "_q", *outs)
        return local.filter("_q").drop("_q")

    totals = []
    for name, spec in specs.items():
        v = F.col(f"_v_{name}")
        whole = (
            F.max_by(v, F.when(v.isNotNull(), F.col("_ts"))) if isinstance(spec, Latest) else F.sum(v)
        )
        totals.append(whole.alias(f"_t_{name}"))
    across = Window.partitionBy(*[F.col(f"_k.{k}") for k in keys]).orderBy("_k._slice").rowsBetween(before, -1)
    # only slices with a cut-off are carried to
    carry = points.groupBy("_k").agg(F.max("_q").alias("_asked"), *totals).select(
        "_k",
        "_asked",
        *[
            (F.last(f"_t_{n}", True) if isinstance(s, Latest) else F.sum(f"_t_{n}"))
            .over(across)
            .alias(f"_c_{n}")
            for n, s in specs.items()
        ],
    ).filter("_asked").drop("_asked")
    local = points.select("_k", "_ts", "_q", *outs).filter("_q")
    joined = local.join(carry, "_k", "left")
    final = []
    for name, spec in specs.items():
        a, c = F.col(name), F.col(f"_c_{name}")
        both = F.coalesce(a, c) if isinstance(spec, Latest) else F.coalesce(a + c, a, c)
        final.append(both.alias(name))
    return joined.select(*named, F.col("_ts").alias(at), *final)


def sliced_rank(
    df: DataFrame,
    *,
    keys: list[str],
    ts: str,
    order: list[Column],
    out: str = "rank",
    counts: dict[str, Column] | None = None,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """1-based position of each row within its key, in time order.

    ``row_number`` inside a slice plus the number of rows in earlier slices; with ``keys=[]`` it
    numbers the whole table without gathering it in one task. ``counts`` adds further running
    counts: {output: condition}, the row itself included.
    """
    extra = counts or {}
    work = df.withColumn("_slice", slice_id(F.col(ts), slice_days))
    totals = work.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_n_{o}") for o, c in extra.items()]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    carry = totals.select(
        *keys, "_slice", carried("_n").alias("_before"), *[carried(f"_n_{o}").alias(f"_b_{o}") for o in extra]
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = work.select(
        "*", F.row_number().over(inside).alias("_pos"), *[F.count_if(c).over(upto).alias(f"_p_{o}") for o, c in extra.items()]
    )
    return placed.join(carry, [*keys, "_slice"]).select(
        *df.columns,
        (F.col("_pos") + F.col("_before")).alias(out),
        *[(F.col(f"_p_{o}") + F.col(f"_b_{o}")).alias(o) for o in extra],
    )


def latest_at(
    history: DataFrame,
    cutoffs: DataFrame,
    *,
    keys: list[str],
    ts: str,
    at: str,
    value: str,
    out: str | None = None,
    inclusive: bool = True,
    first_of_equal: bool = False,
    tie_order: list[str] | None = None,
    slice_days: float | None = SLICE_DAYS,
) -> DataFrame:
    """As-of look-up of one column: (keys, at, value)."""
    spec = Latest(
        F.col(value), tuple(F.col(c) for c in tie_order or ()), first_of_equal, inclusive
    )
    return pit_lookup(
        [(history, ts, {out or value: spec})], cutoffs, keys=keys, at=at, slice_days=slice_days
    )
