"""Probability metrics as grouped aggregates.

``keys`` are the grouping columns ([] = the whole table). Labels are 0/1, ``p`` is P(y = 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions import probability as P

N_BINS = 10
RANK_SLICES = 1024


def _label(y: str) -> Column:
    return F.col(y).cast("double")


def loss_columns(p: str = "p", y: str = "y") -> dict[str, Column]:
    """Per-row log loss and Brier contributions."""
    return {"log_loss": P.log_loss_row(p, y), "brier": P.brier_row(p, y)}


def loss_summary(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", threshold: float = 0.5) -> DataFrame:
    ll, br = P.log_loss_row(p, y), P.brier_row(p, y)
    hit = (F.col(p) >= threshold) == (_label(y) == 1.0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ll).alias("log_loss_mean"),
        F.sum(ll).alias("log_loss_sum"),
        F.avg(br).alias("brier_mean"),
        F.sum(br).alias("brier_sum"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def metric_consistency(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", strict: bool = False) -> DataFrame:
    """Metric values with their identities; ``strict`` fails the job when the mean log loss of two
    or more rows is below the mean Brier score."""
    s = loss_summary(df, keys, p, y)
    n = F.col("n")
    tol = 1e-12
    ordered = F.col("log_loss_mean") >= F.col("brier_mean")
    ok_ll = F.abs(F.col("log_loss_sum") - n * F.col("log_loss_mean")) <= tol * F.greatest(F.lit(1.0), n)
    ok_br = F.abs(F.col("brier_sum") - n * F.col("brier_mean")) <= tol * F.greatest(F.lit(1.0), n)
    out = s.withColumns({
        "sum_mean_consistent": ok_ll,
        "brier_sum_consistent": ok_br,
        "log_loss_ge_brier": ordered,
        "passed": ok_ll & ok_br,
    })
    if strict:
        guard = F.assert_true((n < 2) | ordered, F.lit("mean log loss is below mean Brier score"))
        out = out.withColumn("_guard", guard).filter(F.col("_guard").isNull()).drop("_guard")
    return out


def roc_auc(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Mann-Whitney AUC with average ranks; NaN for one class or a constant p.

    Rows are first counted per distinct p. Ranks are cumulated inside narrow slices of p and the
    slice totals carried over, so no group is ordered in one task as a whole.
    """
    counts = df.groupBy(*keys, F.col(p).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(_label(y) == 1.0).alias("_pos")
    )
    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))) * RANK_SLICES).cast("int")
    counts = counts.withColumn("_cell", cell)
    before = (Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(*before)
    carry = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn")).select(
        *keys, "_cell", F.coalesce(F.sum("_cn").over(across), F.lit(0)).alias("_below")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_p").rowsBetween(*before)
    rank = F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2.0
    totals = (
        counts.join(carry, [*keys, "_cell"])
        .withColumn("_rank", rank)
        .groupBy(*keys)
        .agg(
            F.sum("_pos").cast("double").alias("_np"),
            F.sum(F.col("_n") - F.col("_pos")).cast("double").alias("_nn"),
            F.count(F.lit(1)).alias("_distinct"),
            F.sum(F.col("_pos") * F.col("_rank")).alias("_rs"),
        )
    )
    np_, nn = F.col("_np"), F.col("_nn")
    valid = (np_ > 0) & (nn > 0) & (F.col("_distinct") > 1)
    auc = (F.col("_rs") - np_ * (np_ + 1.0) / 2.0) / (np_ * nn)
    return totals.select(*keys, F.when(valid, auc).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def bin_of(p: str | Column, n_bins: int = N_BINS) -> Column:
    q = F.col(p) if isinstance(p, str) else p
    return F.least(F.lit(n_bins - 1), F.floor(q * n_bins).cast("int"))


def _all_bins(groups: DataFrame, n_bins: int) -> DataFrame:
    return groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))


def reliability_table(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", n_bins: int = N_BINS) -> DataFrame:
    """Mean p (the bin's centre when empty), observed frequency and count of every bin."""
    filled = df.groupBy(*keys, bin_of(p, n_bins).alias("bin")).agg(
        F.avg(p).alias("_mean"),
        F.avg(_label(y)).alias("observed_frequency"),
        F.count(F.lit(1)).alias("_n"),
    )
    if keys:
        groups = filled.select(*keys).distinct()
    else:
        groups = df.sparkSession.range(1).select()
    center = (F.col("bin") + 0.5) / F.lit(float(n_bins))
    return _all_bins(groups, n_bins).join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        F.coalesce("_mean", center).alias("bin_center"),
        "observed_frequency",
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def reliability_points(table: DataFrame) -> DataFrame:
    """Points of the reliability diagram: non-empty bins only."""
    return table.filter(F.col("count") > 0)


def ece_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error from a reliability table; NaN without rows."""
    gap = F.abs(F.col("bin_center") - F.col("observed_frequency"))
    total = F.sum("count")
    return table.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.when(F.col("count") > 0, F.col("count") * gap)) / total)
        .otherwise(F.lit(float("nan")))
        .alias("ece")
    )


def reliability_binned(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", n_bins: int = 3) -> DataFrame:
    """Equal-width bins [lo, hi), the last closed, with Wilson 95% intervals; empty bins are null."""
    cell = F.when(F.col(p) == 1.0, n_bins - 1)
    for i in range(n_bins):
        cell = cell.when((F.col(p) >= i / n_bins) & (F.col(p) < (i + 1) / n_bins), i)
    filled = (
        df.withColumn("bin", cell)
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(_label(y)).alias("_k"),
            F.avg(p).alias("predicted_mean"),
            F.avg(_label(y)).alias("observed"),
        )
    )
    groups = filled.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    low, high = P.wilson_interval("_k", "n")
    return _all_bins(groups, n_bins).join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") / F.lit(float(n_bins))).alias("lo"),
        ((F.col("bin") + 1) / F.lit(float(n_bins))).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "predicted_mean",
        "observed",
        low.alias("ci95_low"),
        high.alias("ci95_high"),
    )


def fold_report(
    scored: DataFrame,
    *,
    fold: str = "fold",
    p: str = "home_advance_probability",
    y: str = "home_advances",
    market: str | None = "market_probability",
    elo: str | None = "elo_probability",
    clear_min: float = 0.62,
) -> DataFrame:
    """All report metrics per fold; a missing market or rating probability counts as 0.5."""
    clear = (F.col(p) >= clear_min) | (F.col(p) <= 1.0 - clear_min)
    hit = ((F.col(p) >= 0.5) == (_label(y) == 1.0)).cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n_test"),
        F.avg(P.log_loss_row(p, y)).alias("log_loss"),
        F.avg(P.brier_row(p, y)).alias("brier_score"),
        F.avg(hit).alias("accuracy"),
        F.avg(clear.cast("double")).alias("coverage_clear_lean"),
        F.avg(F.when(clear, hit)).alias("accuracy_clear_lean"),
    ]
    for name, column in (("market", market), ("elo", elo)):
        if column:
            q = F.coalesce(F.col(column), F.lit(0.5))
            aggs += [
                F.avg(P.log_loss_row(q, y)).alias(f"log_loss_{name}"),
                F.avg(P.brier_row(q, y)).alias(f"brier_{name}"),
            ]
    base = scored.groupBy(fold).agg(*aggs)
    auc = roc_auc(scored, [fold], p, y)
    ece = ece_of(reliability_table(scored, [fold], p, y), [fold])
    return base.join(auc, fold, "left").join(ece, fold, "left")


SUMMARY_KEYS = (
    "log_loss", "brier_score", "accuracy", "roc_auc", "coverage_clear_lean", "accuracy_clear_lean",
    "log_loss_market", "brier_market", "log_loss_elo", "brier_elo", "ece",
)


def summarize_folds(report: DataFrame) -> DataFrame:
    """Unweighted mean over folds, nulls and NaN skipped."""
    have = [k for k in SUMMARY_KEYS if k in report.columns]
    return report.agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[F.avg(F.when(~F.isnan(k), F.col(k))).alias(k) for k in have],
    )


def calibration_view(summary: DataFrame) -> DataFrame:
    """Summary columns that concern calibration, as (metric, value) rows."""
    names = [c for c in summary.columns if "calibrat" in c or "ece" in c]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return summary.select(F.explode(pairs).alias("s")).select("s.*")


def prevalence(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg(F.avg(_label(y)).alias("prevalence"))


def constant_baseline(train: DataFrame, test: DataFrame, y: str = "y") -> DataFrame:
    """Score every test row with the training prevalence (0.5 without training rows)."""
    rate = prevalence(train, y).select(F.coalesce("prevalence", F.lit(0.5)).alias("p"))
    return test.withColumn("p", rate.scalar())


def row_counts(df: DataFrame, match_id: str = "match_id", is_test: str = "is_test") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_distinct(match_id).alias("n_unique"),
        F.count_distinct(F.when(F.col(is_test), F.col(match_id))).alias("n_unique_test"),
    )


def worst_rows(df: DataFrame, k: int, loss: str = "log_loss_contribution", tie: str = "match_id") -> DataFrame:
    """The audit's top-k rows by loss."""
    return df.orderBy(F.col(loss).desc(), F.col(tie)).limit(k)
