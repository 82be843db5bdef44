"""Model queries: fits have no SQL twin, the tables around them do where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.features import V1_SQL, V1_VIEWS, features, v1_features
from cutline.catalog.metrics import FOLDS_SQL
from cutline.catalog.registry import Registry
from cutline.operators import models as M
from cutline.operators.features import V1_FEATURES
from cutline.operators.folds import positional_split
from cutline.plans.store import materialize

REGISTRY = Registry()
query = REGISTRY.query


def labelled_v1(v):
    labels = v.results.select("match_id", F.col("home_advances").cast("int").alias("home_advances"))
    return v1_features(v).join(labels, "match_id")


def v1_parts(v):
    rows = materialize(labelled_v1(v), "v1")
    split = positional_split(rows.select("match_id", "kickoff_at")).select("match_id", "part")
    return materialize(rows.join(split, "match_id"), "v1-split")


@query(
    "missing_indicators",
    """SELECT match_id, CAST(market_probability IS NULL AS INTEGER) AS market_probability_isna, CAST(elo_probability IS NULL AS INTEGER) AS elo_probability_isna,
      0 AS home_advance_probability_isna FROM scored""",
    ("scored",),
)
def missing_indicators(v):
    cols = ["market_probability", "elo_probability", "home_advance_probability"]
    return M.add_missing_indicators(v.scored, cols).select("match_id", *[f"{c}_isna" for c in cols])


NUMBERS = "SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_linenumber <> 3 THEN l_discount END FROM lineitem"


@query(
    "training_scaling",
    f"""WITH n AS ({NUMBERS}), m AS (SELECT feature, median(v) AS median FROM n GROUP BY 1)
    SELECT feature, round(median, 6) AS median, round(avg(coalesce(v, median)), 6) AS mean, round(stddev_pop(coalesce(v, median)), 5) AS scale FROM n JOIN m USING (feature) GROUP BY ALL""",
)
def training_scaling(v):
    """Exact medians, and mean and deviation after imputation."""
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    li = v.table("lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))
    s = M.fit_scaling(li, cols)
    rows = [(c, s.median[c], s.mean[c], round(s.scale[c], 5)) for c in s.columns]
    return v.spark.createDataFrame(rows, "feature string, median double, mean double, scale double")


@query(
    "feature_label_frame",
    f"{V1_SQL} SELECT match_id, round(elo_difference, 6) + 0.0 AS elo_difference, round(form_difference, 6) + 0.0 AS form_difference, CAST(home_advances AS INTEGER) AS home_advances FROM v1 JOIN results USING (match_id)",
    V1_VIEWS,
)
def feature_label_frame(v):
    return labelled_v1(v).select("match_id", "elo_difference", "form_difference", "home_advances")


@query(
    "stack_inputs",
    "SELECT match_id, round(coalesce(market_probability, 0.5 * (coalesce(elo_probability, 0.5) + home_advance_probability)), 6) AS market_filled FROM scored",
    ("scored",),
)
def stack_inputs(v):
    s = v.scored.select(
        "match_id", "market_probability", F.coalesce("elo_probability", F.lit(0.5)).alias("elo_probability"),
        F.col("home_advance_probability").alias("base_probability"),
    )
    return s.select("match_id", M.filled_market().alias("market_filled"))


@query("logistic_predictions")
def logistic_predictions(v):
    """L2 logistic on the 15 features: fit on the first half, scored on the last quarter."""
    rows = v1_parts(v)
    model = M.fit_logistic(rows.filter("part = 'train'"), V1_FEATURES)
    return model.predict(rows.filter("part = 'test'")).select("match_id", "home_advances", "base_probability")


@query("logistic_importance")
def logistic_importance(v):
    model = M.fit_logistic(v1_parts(v).filter("part = 'train'"), V1_FEATURES)
    return M.importance_table(v.spark, model.importance(), 10)


@query("boosted_predictions")
def boosted_predictions(v):
    rows = v1_parts(v)
    model = M.fit_boosted(rows.filter("part = 'train'"), rows.filter("part = 'validation'"), V1_FEATURES)
    return model.predict(rows.filter("part = 'test'")).select("match_id", "home_advances", "base_probability")


def _stack_rows(v):
    return v.scored.select(
        "match_id", "kickoff_at", "home_advances", "market_probability",
        F.coalesce("elo_probability", F.lit(0.5)).alias("elo_probability"),
        F.col("home_advance_probability").alias("base_probability"),
    )


@query("stacked_predictions")
def stacked_predictions(v):
    rows = _stack_rows(v)
    return M.fit_stacker(rows).predict(rows).select("match_id", "stacked_probability")


@query(
    "weighted_blend",
    """SELECT match_id, round(0.5 * coalesce(market_probability, 0.5 * (coalesce(elo_probability, 0.5) + home_advance_probability))
      + 0.1 * coalesce(elo_probability, 0.5) + 0.4 * home_advance_probability, 6) AS stacked_probability FROM scored""",
    ("scored",),
)
def weighted_blend(v):
    """The stacker that needs no fit."""
    return M.Stacker("weighted_blend").predict(_stack_rows(v)).select("match_id", "stacked_probability")


@query(
    "select_base_learner",
    f"""WITH {FOLDS_SQL}, n AS (SELECT fold, count(*) FILTER (kickoff_at BETWEEN train_start AND train_end) AS n_train,
      count(*) FILTER (kickoff_at BETWEEN validation_start AND validation_end) AS n_validation FROM folds CROSS JOIN duels GROUP BY fold)
    SELECT fold, n_train, n_validation, CASE WHEN n_train < 2500 OR n_validation < 1 THEN 'logistic' ELSE 'boosted' END AS learner,
      CASE WHEN n_train < 2500 THEN 'n_train=' || n_train || ' < 2500' WHEN n_validation < 1 THEN 'no_validation_examples' ELSE 'enabled' END AS reason FROM n""",
    ("duels",),
)
def select_base_learner(v):
    """The learner of each walk-forward fold, from the sizes of its windows."""
    from cutline.catalog.metrics import walk_folds
    from cutline.operators.folds import fold_membership

    parts = fold_membership(v.duels.select("match_id", "kickoff_at"), walk_folds(v)).groupBy("fold").agg(
        F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "validation").alias("w")
    )
    rows = [(r["fold"], r["t"], r["w"], *M.select_base_learner(True, r["t"], r["w"], 2500)) for r in parts.collect()]
    return v.spark.createDataFrame(rows, "fold string, n_train long, n_validation long, learner string, reason string")


OOF_SQL = f"""{V1_SQL}, l AS (SELECT match_id, t.kickoff_at AS k FROM v1 JOIN results AS t USING (match_id)),
  r AS (SELECT *, row_number() OVER (ORDER BY k) AS pos, count(*) OVER () AS n FROM l),
  c AS (SELECT DISTINCT r.k AS cut FROM r, range(1, 6) AS js(j) WHERE pos = (n * j + 5) // 6 + 1 AND r.k > (SELECT min(k) FROM r)),
  b AS (SELECT match_id, k, (SELECT count(*) FROM c WHERE cut <= k) AS block FROM l)"""


@query(
    "out_of_fold_sources",
    f"""{OOF_SQL} SELECT match_id, CAST(block AS INTEGER) AS block, CASE WHEN block > 0 THEN 'block_' || block END AS source,
      (SELECT max(cut) FROM c WHERE cut <= k) AS trained_until, block > 0 AS scored FROM b""",
    V1_VIEWS,
)
def out_of_fold_sources(v):
    """Block and source model of each row, and the instant that everything its model saw lies before."""
    from cutline.plans.training import out_of_fold

    rows = materialize(labelled_v1(v), "v1")
    return out_of_fold(rows, V1_FEATURES).select("match_id", "block", "source", "trained_until", F.col("base_probability").isNotNull().alias("scored"))


@query("out_of_fold_stack")
def out_of_fold_stack(v):
    """The stacker on out-of-fold scores of the training window, scored on the test window."""
    from cutline.plans.training import TrainConfig, train

    rows = labelled_features(v)
    fitted = train(_window(rows, *WINDOWS["train"]), _window(rows, *WINDOWS["validation"]), TrainConfig(oof_splits=5))
    return fitted.score(_window(rows, *WINDOWS["test"])).select("match_id", "base_probability", "stacked_probability", "calibrated_probability")


@query("isotonic_calibration")
def isotonic_calibration(v):
    rows = v.scored.withColumnRenamed("home_advance_probability", "stacked_probability")
    return M.fit_calibrator(rows).predict(rows).select("match_id", "calibrated_probability")


@query("platt_calibration")
def platt_calibration(v):
    rows = v.scored.withColumnRenamed("home_advance_probability", "stacked_probability")
    return M.fit_calibrator(rows, method="platt").predict(rows).select("match_id", "calibrated_probability")


def labelled_features(v):
    labels = v.results.select("match_id", F.col("home_advances").cast("int").alias("home_advances"))
    return materialize(features(v).join(labels, "match_id"), "features")


def _window(df, a, b):
    return df.filter((F.col("kickoff_at") >= F.lit(a).cast("timestamp")) & (F.col("kickoff_at") <= F.lit(b).cast("timestamp")))


WINDOWS = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}


def trained(v, rows):
    from cutline.plans.training import TrainConfig, train

    return train(_window(rows, *WINDOWS["train"]), _window(rows, *WINDOWS["validation"]), TrainConfig())


@query("train_run_record")
def train_run_record(v):
    """Full training on temporal windows; one run row per component."""
    from cutline.plans.training import TrainConfig, run_record

    windows = {f"{k}_{e}": x for k, ab in WINDOWS.items() for e, x in zip(("start", "end"), ab, strict=True)}
    return run_record(v.spark, trained(v, labelled_features(v)), "v0.1.0", windows, TrainConfig())


@query("predict_ledger_rows")
def predict_ledger_rows(v):
    """Every match of the spine scored by the trained components, explained and ready to append."""
    from cutline.plans.prediction import predict

    # The labels of a match are stored beside its features: the passes of the fits read one table and join nothing.
    labels = v.results.groupBy("match_id").agg(F.collect_list(F.col("home_advances").cast("int")).alias("_labels"))
    rows = materialize(features(v).join(labels, "match_id", "left"), "features")
    own = rows.select(*[c for c in rows.columns if c != "_labels"], F.explode("_labels").alias("home_advances"))
    return predict(rows.drop("_labels"), "v0.1.0", trained(v, own))


@query("component_probabilities")
def component_probabilities(v):
    rows = labelled_features(v)
    return trained(v, rows).components(_window(rows, *WINDOWS["validation"])).select("match_id", *M.STACK_INPUTS)


@query("walk_forward_report")
def walk_forward_report(v):
    from cutline.catalog.metrics import walk_folds
    from cutline.operators.folds import fold_violations
    from cutline.plans.backtest import backtest_report, walk_forward

    folds = walk_folds(v)
    folds = folds.join(fold_violations(folds).select("fold").distinct(), "fold", "left_anti")
    rows = features(v).join(
        v.results.select("match_id", F.col("home_advances").cast("int").alias("home_advances")), "match_id"
    )
    return backtest_report(walk_forward(rows, folds))["folds"]


def _report(v):
    from cutline.plans.report import baseline_report

    rows = materialize(labelled_v1(v), "v1")
    split = positional_split(rows.select("match_id", "kickoff_at")).select("match_id", "part")
    return baseline_report(rows, split)


@query("baseline_report_metrics")
def baseline_report_metrics(v):
    return _report(v)["metrics"]


@query("baseline_report_reliability")
def baseline_report_reliability(v):
    return _report(v)["reliability"]


@query("logistic_symmetry")
def logistic_symmetry(v):
    return _report(v)["symmetry"]
