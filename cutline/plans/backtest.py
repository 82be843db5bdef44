"""Walk-forward backtest over a few configured folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.operators import models as M
from cutline.operators.folds import validate_folds, window_of
from cutline.operators.metrics import fold_report, reliability_table, summarize_folds
from cutline.plans.store import materialize
from cutline.plans.training import TrainConfig, train


def _windows(folds: list, part: str, ts: str = "kickoff_at") -> dict[str, Column]:
    return {f["fold"]: F.col(ts).between(F.lit(f[f"{part}_start"]), F.lit(f[f"{part}_end"])) for f in folds}


def _by_fold(values: dict[str, Column]) -> Column:
    """The value of a row's own fold."""
    return F.coalesce(*[F.when(F.col("fold") == f, v) for f, v in values.items()])


def _in_folds(rows: DataFrame, members: dict[str, Column], bases: dict[str, M.LogisticModel], keep: list[str], out: str) -> DataFrame:
    """A row for each fold whose window it lies in, with the score of that fold's model: one pass over the table."""
    each = [F.when(members[f], F.lit(f)) for f in members]
    own = rows.withColumn("fold", F.explode(F.array_compact(F.array(*each))))
    return own.select("fold", *keep, M.window_probability(bases, rows.columns, F.col("fold")).alias(out))


def _together(rows: DataFrame, folds: list, cfg: TrainConfig) -> DataFrame:
    """All folds side by side: base learners, stackers and calibrators of all folds in one fit each."""
    train_in, val_in, test_in = (_windows(folds, p) for p in ("train", "validation", "test"))
    counts = rows.agg(*[F.count_if(m[f]).alias(f"{i}_{k}") for i, m in enumerate((train_in, val_in)) for k, f in enumerate(m)]).first()
    if not all(counts):
        raise ValueError("training and validation windows must both contain labelled matches")
    columns = [c for c in cfg.features if c in rows.columns]
    bases = M.fit_logistics(rows, columns, train_in, cfg.label, cfg.logistic)
    rows = rows.withColumn("elo_probability", F.col("elo_home_advance_probability"))
    keep = ["match_id", "kickoff_at", "cutoff_time", cfg.label, *M.STACK_INPUTS[:2]]
    val = materialize(_in_folds(rows, val_in, bases, keep, "base_probability"), "backtest-validation")
    stackers = M.fit_stackers(val, {f: F.col("fold") == f for f in val_in}, cfg.label, cfg.stacking)
    stacked = lambda df: df.withColumn("stacked_probability", _by_fold({f: s.probability() for f, s in stackers.items()}))
    test = stacked(_in_folds(rows, test_in, bases, keep, "base_probability"))
    calibrator = M.fit_calibrator(stacked(val), label=cfg.label, method="isotonic", keys=("fold",))
    return calibrator.predict(test)


def walk_forward(labelled: DataFrame, folds: DataFrame, config: TrainConfig | None = None) -> DataFrame:
    """Per fold: train on its windows, score its test window; predictions of all folds.

    ``labelled`` is the feature table with ``home_advances``: it is built once, its rows are already as of their own cut-off. Logistic folds are
    fitted together, each pass over the table serving all of them; other settings fit fold after fold. The driver loops over fold
    definitions, never over rows.
    """
    cfg = config or TrainConfig()
    rows = materialize(labelled, "backtest-features")
    defined = validate_folds(folds).collect()
    names = ("match_id", "cutoff_time", "kickoff_at", F.col("calibrated_probability").alias("home_advance_probability"), "market_probability", "elo_probability", "base_probability", "home_advances")
    plain = (cfg.boosted_enabled, cfg.split_validation, cfg.oof_splits) == (False, False, 0)
    if plain and cfg.stacking == "logistic" and cfg.calibration == "isotonic":
        return _together(rows, defined, cfg).select("fold", *names)
    parts = []
    for f in defined:
        win = lambda p, f=f: window_of(rows, F.lit(f[f"{p}_start"]), F.lit(f[f"{p}_end"]))
        parts.append(train(win("train"), win("validation"), cfg).score(win("test")).select(F.lit(f["fold"]).alias("fold"), *names))
    return reduce(DataFrame.unionByName, parts)


def backtest_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Per-fold metrics, their summary and the reliability table of each fold."""
    folds = fold_report(predictions)
    return {
        "folds": folds,
        "summary": summarize_folds(folds),
        "reliability": reliability_table(predictions, ["fold"], "home_advance_probability", "home_advances"),
    }
