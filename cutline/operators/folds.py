"""Temporal folds, positional split, mirrors, symmetry and the challenger gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.operators.pit import sliced_rank

FOLD_FIELDS = (
    "train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end",
)


def fold_violations(folds: DataFrame) -> DataFrame:
    """Folds whose windows are not in strict temporal order, with the first broken rule."""
    c = F.col
    broken = (
        F.when(~(c("train_start") < c("train_end")), "train_start must be < train_end")
        .when(~(c("train_end") < c("validation_start")), "train_end must be < validation_start")
        .when(~(c("validation_start") < c("validation_end")), "validation_start must be < validation_end")
        .when(~(c("validation_end") <= c("test_start")), "validation_end must be <= test_start")
        .when(~(c("test_start") < c("test_end")), "test_start must be < test_end")
    )
    return folds.withColumn("violation", broken).filter(F.col("violation").isNotNull())


def validate_folds(folds: DataFrame) -> DataFrame:
    """The folds unchanged; a broken one fails."""
    bad = fold_violations(folds).limit(1).collect()
    if bad:
        raise ValueError(f"Fold {bad[0]['fold']!r}: {bad[0]['violation']}")
    return folds


MAX_FOLDS = 10_000


def fold_membership(matches: DataFrame, folds: DataFrame, ts: str = "kickoff_at") -> DataFrame:
    """(match, fold, part) with both window ends inclusive.

    Folds are configuration: a handful of rows, so the range join broadcasts them, after a check that they are few.
    """
    if folds.limit(MAX_FOLDS + 1).count() > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} folds: these are not a configuration")
    windows = folds.select(
        "fold",
        F.explode(F.array(*[
            F.struct(F.lit(part).alias("part"), F.col(f"{part}_start").alias("_lo"), F.col(f"{part}_end").alias("_hi"))
            for part in ("train", "validation", "test")
        ])).alias("w"),
    ).select("fold", "w.*")
    return matches.join(
        F.broadcast(windows), (F.col(ts) >= F.col("_lo")) & (F.col(ts) <= F.col("_hi"))
    ).drop("_lo", "_hi")


def window_of(matches: DataFrame, start: Column, end: Column, ts: str = "kickoff_at") -> DataFrame:
    return matches.filter((F.col(ts) >= start) & (F.col(ts) <= end))


def positional_split(
    df: DataFrame, *, ts: str = "kickoff_at", tie: str = "match_id", shares=(0.5, 0.75)
) -> DataFrame:
    """Chronological 50/25/25 split by position, at least one training and one validation row.

    Positions come from per-slice counts, so the table is never ordered in one task.
    """
    ranked = sliced_rank(df, keys=[], ts=ts, order=[F.col(ts), F.col(tie)], out="position", slice_days=1)
    n = df.agg(F.count(F.lit(1)).alias("_n")).scalar()
    train_end = F.greatest(F.lit(1), F.floor(F.col("_n") * shares[0]))
    val_end = F.greatest(train_end + 1, F.floor(F.col("_n") * shares[1]))
    part = F.when(F.col("position") <= train_end, "train").when(F.col("position") <= val_end, "validation").otherwise("test")
    return ranked.withColumn("_n", n).withColumn("part", part).drop("_n")


def _swapped(
    df: DataFrame, *, swap: list[tuple[str, str]], negate: list[str] = (), complement: list[str] = (), flip: list[str] = ()
) -> dict[str, Column]:
    """The columns that the mirror changes."""
    new: dict[str, Column] = {}
    for a, b in swap:
        new[a], new[b] = F.col(b), F.col(a)
    new |= {c: -F.col(c) for c in negate}
    new |= {c: 1.0 - F.col(c) for c in complement}
    new |= {c: ~F.col(c) if dict(df.dtypes)[c] == "boolean" else 1 - F.col(c) for c in flip}
    return new


def mirror(df: DataFrame, **sides) -> DataFrame:
    """Swap the sides: paired columns exchanged, differences negated, probabilities complemented,
    labels flipped. Other columns, the fold among them, stay."""
    new = _swapped(df, **sides)
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def mirror_augment(df: DataFrame, **sides) -> DataFrame:
    """Originals and mirrors with ``is_mirror``, in the same fold. Both come from one reading of the table: a union would work it out twice, and
    where the planner keeps the partitions of a union together, both times in one task."""
    new = _swapped(df, **sides)
    both = df.withColumn("is_mirror", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select(*[F.when(F.col("is_mirror"), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in df.columns], "is_mirror")


def symmetry_test(
    forward: DataFrame, reverse: DataFrame, keys: list[str], p: str = "p", tolerance: float = 0.05
) -> DataFrame:
    """Residuals |p(A,B) + p(B,A) - 1| of two scorings of the same matches; fails when empty."""
    j = forward.select(*keys, F.col(p).alias("_f")).join(reverse.select(*keys, F.col(p).alias("_r")), keys)
    res = F.abs(F.col("_f") + F.col("_r") - 1.0)
    fails = F.count_if(res > tolerance)
    n = F.count(F.lit(1))
    return j.agg(
        n.alias("n_pairs"),
        F.count_if(res <= tolerance).alias("n_passes"),
        fails.alias("n_fails"),
        F.coalesce(F.avg(res), F.lit(0.0)).alias("mean_abs_residual"),
        F.coalesce(F.max(res), F.lit(0.0)).alias("max_abs_residual"),
        F.lit(float(tolerance)).alias("tolerance"),
        ((fails == 0) & (n > 0)).alias("passes"),
    )


GATE_DEFAULTS = {
    "enabled": False,
    "min_folds": 2,
    "min_log_loss_improvement": 0.005,
    "min_brier_improvement": 0.005,
    "min_coverage_improvement": 0.0,
    "require_calibration_improvement": True,
    "require_reliability_improvement": True,
}


def gate_folds(fold_metrics: DataFrame, config: dict | None = None) -> DataFrame:
    """Per fold: does the challenger beat the baseline, and by the required margins?

    Columns {log_loss,brier,coverage,calibration,reliability}_{base,challenger}.
    """
    cfg = {**GATE_DEFAULTS, **(config or {})}
    c = F.col
    beats = (c("log_loss_challenger") + cfg["min_log_loss_improvement"] < c("log_loss_base")) & (
        c("brier_challenger") + cfg["min_brier_improvement"] < c("brier_base")
    )
    meets = beats & (c("coverage_challenger") + cfg["min_coverage_improvement"] >= c("coverage_base"))
    for name in ("calibration", "reliability"):
        if cfg[f"require_{name}_improvement"]:
            a, b = c(f"{name}_challenger"), c(f"{name}_base")
            meets = meets & F.coalesce(a <= b, F.lit(True))
    return fold_metrics.withColumns({"challenger_beats": beats, "meets_threshold": meets})


def gate_decision(fold_metrics: DataFrame, config: dict | None = None) -> DataFrame:
    """One row: folds evaluated, folds won, does the challenger become the default, and why."""
    cfg = {**GATE_DEFAULTS, **(config or {})}
    need = int(cfg["min_folds"])
    agg = gate_folds(fold_metrics, config).agg(
        F.count(F.lit(1)).alias("n_folds_evaluated"),
        F.count_if("meets_threshold").alias("n_folds_won"),
    )
    won, n = F.col("n_folds_won"), F.col("n_folds_evaluated")
    enough = (won >= need) & F.lit(bool(cfg["enabled"]))
    counts = F.format_string("%d of %d folds", won, n)
    reason = (
        F.lit("challenger_disabled_in_config")
        if not cfg["enabled"]
        else F.when(
            won < need,
            F.concat(
                F.lit("only "), counts, F.lit(f" beat the baseline by the required margins (need {need})")
            ),
        ).otherwise(F.concat(F.lit("challenger beats the baseline on "), counts))
    )
    return agg.withColumns({"becomes_default": enough, "reason": reason})
