"""Metric, split and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.catalog.registry import Registry
from cutline.functions import probability as P
from cutline.operators import folds as O
from cutline.operators import metrics as M

REGISTRY = Registry()
query = REGISTRY.query

PY = "(SELECT fold, match_id, home_advance_probability AS p, home_advances AS y, market_probability AS mp, elo_probability AS ep FROM scored)"
LL = "-(y * ln(greatest(1e-12, least(1 - 1e-12, {p}))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, {p}))))"


def loss(p="p"):
    return LL.format(p=p)


def brier(p="p"):
    return f"({p} - y) * ({p} - y)"


def _py(v):
    return v.scored.withColumnsRenamed({"home_advance_probability": "p", "home_advances": "y"})


@query("per_row_losses", f"SELECT match_id, round({loss()}, 6) AS log_loss, round({brier()}, 6) AS brier FROM {PY}", ("scored",))
def per_row_losses(v):
    return _py(v).select("match_id", *[c.alias(n) for n, c in M.loss_columns().items()])


SUMS = f"""count(*) AS n, round(avg({loss()}), 6) AS log_loss_mean, round(sum({loss()}), 6) AS log_loss_sum,
  round(avg({brier()}), 6) AS brier_mean, round(sum({brier()}), 6) AS brier_sum,
  round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy"""


@query("loss_by_fold", f"SELECT fold, {SUMS} FROM {PY} GROUP BY fold", ("scored",))
def loss_by_fold(v):
    return M.loss_summary(_py(v), ["fold"])


@query("loss_documents", f"SELECT fold, {SUMS} FROM doc_scored GROUP BY fold", ("doc_scored",))
def loss_documents(v):
    return M.loss_summary(v.doc_scored, ["fold"])


@query(
    "metric_consistency",
    f"""SELECT fold, {SUMS}, true AS sum_mean_consistent, true AS brier_sum_consistent, avg({loss()}) >= avg({brier()}) AS log_loss_ge_brier, true AS passed
    FROM {PY} GROUP BY fold""",
    ("scored",),
)
def metric_consistency(v):
    return M.metric_consistency(_py(v), ["fold"], strict=True)


AUC = """auc AS (
  SELECT {k}, CASE WHEN max(np) > 0 AND max(n) > max(np) AND count(DISTINCT p) > 1
    THEN (sum(r) FILTER (y = 1) - max(np) * (max(np) + 1) / 2.0::DOUBLE) / (max(np) * (max(n) - max(np))) ELSE 'nan'::DOUBLE END AS roc_auc
  FROM (SELECT {k}, p, y, count(*) OVER w AS n, sum(y) OVER w AS np,
      rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0::DOUBLE AS r
    FROM {src} WINDOW w AS (PARTITION BY {k})) GROUP BY {k})"""


@query("roc_auc", f"WITH {AUC.format(k='fold', src=PY)} SELECT fold, round(roc_auc, 6) AS roc_auc FROM auc", ("scored",))
def roc_auc(v):
    return M.roc_auc(_py(v), ["fold"])


@query(
    "roc_auc_overall",
    f"WITH one AS (SELECT 1 AS k, p, y FROM {PY}), {AUC.format(k='k', src='one')} SELECT round(roc_auc, 6) AS roc_auc FROM auc",
    ("scored",),
)
def roc_auc_overall(v):
    return M.roc_auc(_py(v), [])


REL = """rel AS (
  SELECT g.fold, b AS bin, coalesce(avg(p), (b + 0.5::DOUBLE) / {n}) AS bin_center, avg(CAST(y AS DOUBLE)) AS observed_frequency, count(p) AS count
  FROM (SELECT DISTINCT fold FROM {src}) g CROSS JOIN (SELECT CAST(range AS INTEGER) AS b FROM range({n})) r
  LEFT JOIN {src} s ON s.fold = g.fold AND least({n} - 1, CAST(floor(p * {n}) AS INTEGER)) = b GROUP BY g.fold, b)"""
REL_SELECT = "SELECT fold, bin, round(bin_center, 6) AS bin_center, round(observed_frequency, 6) AS observed_frequency, count FROM rel"


@query("reliability_table", f"WITH {REL.format(n=10, src=PY)} {REL_SELECT}", ("scored",))
def reliability_table(v):
    return M.reliability_table(_py(v), ["fold"])


@query("reliability_documents", f"WITH {REL.format(n=10, src='doc_scored')} {REL_SELECT}", ("doc_scored",))
def reliability_documents(v):
    return M.reliability_table(v.doc_scored, ["fold"])


@query("reliability_points", f"WITH {REL.format(n=10, src='doc_scored')} {REL_SELECT} WHERE count > 0", ("doc_scored",))
def reliability_points(v):
    return M.reliability_points(M.reliability_table(v.doc_scored, ["fold"]))


ECE = "ece AS (SELECT fold, sum(CASE WHEN count > 0 THEN count * abs(bin_center - observed_frequency) END) / sum(count) AS ece FROM rel GROUP BY fold)"


@query(
    "expected_calibration_error",
    f"WITH {REL.format(n=10, src=PY)}, {ECE} SELECT fold, round(ece, 6) AS ece FROM ece",
    ("scored",),
)
def expected_calibration_error(v):
    return M.ece_of(M.reliability_table(_py(v), ["fold"]), ["fold"])


@query(
    "reliability_binned",
    f"""SELECT fold, bin, round(bin / 3.0::DOUBLE, 6) AS lo, round((bin + 1) / 3.0::DOUBLE, 6) AS hi, n, round(pm, 6) AS predicted_mean, round(o, 6) AS observed,
      round(greatest(0, (o + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(o * (1 - o) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS ci95_low,
      round(least(1, (o + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(o * (1 - o) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS ci95_high
    FROM (SELECT fold, CASE WHEN p < 1 / 3.0::DOUBLE THEN 0 WHEN p < 2 / 3.0::DOUBLE THEN 1 ELSE 2 END AS bin, count(*) AS n, avg(p) AS pm, avg(CAST(y AS DOUBLE)) AS o,
      1.96::DOUBLE * 1.96 AS z2 FROM {PY} GROUP BY ALL)""",
    ("scored",),
)
def reliability_binned(v):
    return M.reliability_binned(_py(v), ["fold"])


@query(
    "wilson_interval",
    """SELECT fold, round(greatest(0, (o + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(o * (1 - o) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS low,
      round(least(1, (o + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(o * (1 - o) / n + z2 / (4.0 * n * n)) / (1 + z2 / n)), 6) AS high
    FROM (SELECT fold, count(*) AS n, avg(CAST(y AS DOUBLE)) AS o, 1.96::DOUBLE * 1.96 AS z2 FROM doc_scored GROUP BY fold)""",
    ("doc_scored",),
)
def wilson_interval(v):
    g = v.doc_scored.groupBy("fold").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = P.wilson_interval("k", "n")
    return g.select("fold", low.alias("low"), high.alias("high"))


REPORT = f"""WITH {AUC.format(k='fold', src=PY)}, {REL.format(n=10, src=PY)}, {ECE},
base AS (SELECT fold, count(*) AS n_test, avg({loss()}) AS log_loss, avg({brier()}) AS brier_score, avg(hit) AS accuracy,
    avg(CAST(clear AS DOUBLE)) AS coverage_clear_lean, avg(hit) FILTER (clear) AS accuracy_clear_lean,
    avg({loss('coalesce(mp, 0.5)')}) AS log_loss_market, avg({brier('coalesce(mp, 0.5)')}) AS brier_market,
    avg({loss('coalesce(ep, 0.5)')}) AS log_loss_elo, avg({brier('coalesce(ep, 0.5)')}) AS brier_elo
  FROM (SELECT *, CAST((p >= 0.5) = (y = 1) AS DOUBLE) AS hit, p >= 0.62 OR p <= 1 - 0.62 AS clear FROM {PY}) GROUP BY fold),
report AS (SELECT * FROM base JOIN auc USING (fold) JOIN ece USING (fold))"""
REPORT_COLS = [
    "log_loss", "brier_score", "accuracy", "coverage_clear_lean", "accuracy_clear_lean", "log_loss_market",
    "brier_market", "log_loss_elo", "brier_elo", "roc_auc", "ece",
]


@query(
    "fold_report",
    f"{REPORT} SELECT fold, n_test, {', '.join(f'round({c}, 6) AS {c}' for c in REPORT_COLS)} FROM report",
    ("scored",),
)
def fold_report(v):
    return M.fold_report(v.scored)


@query(
    "fold_summary",
    f"{REPORT} SELECT count(*) AS n_folds, {', '.join(f'round(avg({c}), 6) AS {c}' for c in REPORT_COLS)} FROM report",
    ("scored",),
)
def fold_summary(v):
    return M.summarize_folds(M.fold_report(v.scored))


@query("calibration_view", f"{REPORT} SELECT 'ece' AS metric, round(avg(ece), 6) AS value FROM report", ("scored",))
def calibration_view(v):
    return M.calibration_view(M.summarize_folds(M.fold_report(v.scored)))


@query(
    "constant_baseline",
    "SELECT match_id, fold, round((SELECT avg(home_advances) FROM scored WHERE kickoff_at < TIMESTAMP '1999-01-01'), 6) AS p FROM scored WHERE kickoff_at >= TIMESTAMP '1999-01-01'",
    ("scored",),
)
def constant_baseline(v):
    cut = F.to_timestamp(F.lit("1999-01-01"))
    s = v.scored
    return M.constant_baseline(s.filter(F.col("kickoff_at") < cut), s.filter(F.col("kickoff_at") >= cut), "home_advances").select(
        "match_id", "fold", "p"
    )


@query(
    "row_counts",
    "SELECT count(*) AS n_total, count(DISTINCT home_team_id) AS n_unique, count(DISTINCT home_team_id) FILTER (fold = 'fold_2001') AS n_unique_test FROM scored",
    ("scored",),
)
def row_counts(v):
    return M.row_counts(v.scored.withColumn("is_test", F.col("fold") == "fold_2001"), "home_team_id")


@query(
    "confidence_band",
    """SELECT match_id, CASE WHEN p < 0 OR p > 1 THEN NULL WHEN p >= 0.62 OR p <= 1 - 0.62 THEN 'clear_lean'
      WHEN p >= 0.55 OR p <= 1 - 0.55 THEN 'slight_lean' ELSE 'near_coin_flip' END AS band
    FROM (SELECT match_id, home_advance_probability * 1.1 - 0.05 AS p FROM scored)""",
    ("scored",),
)
def confidence_band(v):
    return v.scored.select("match_id", P.confidence_band(F.col("home_advance_probability") * 1.1 - 0.05).alias("band"))


@query(
    "logit_clip_blend",
    f"""SELECT match_id, round(ln(q / (1 - q)), 6) AS logit, round(q, 6) AS clipped,
      round(CASE WHEN mp IS NULL THEN 0.5 * e + 0.5 * p ELSE 0.5 * mp + 0.1 * e + 0.4 * p END, 6) AS blend,
      round(greatest(1e-6, least(1 - 1e-6, 0.5 * coalesce(mp, 0.5 * (e + p)) + 0.1 * e + 0.4 * p)), 6) AS weighted
    FROM (SELECT *, coalesce(ep, 0.5) AS e, greatest(1e-6, least(1 - 1e-6, p * 1.2 - 0.1)) AS q FROM {PY})""",
    ("scored",),
)
def logit_clip_blend(v):
    s = _py(v).withColumns({"e": F.coalesce("elo_probability", F.lit(0.5)), "x": F.col("p") * 1.2 - 0.1})
    filled = F.coalesce("market_probability", 0.5 * (F.col("e") + F.col("p")))
    return s.select(
        "match_id", P.logit("x").alias("logit"), P.clip("x").alias("clipped"),
        P.blend("market_probability", "e", "p").alias("blend"), P.weighted_blend(filled, "e", "p").alias("weighted"),
    )


# -- folds -----------------------------------------------------------------------------------

FOLDS_SQL = """folds AS (
  SELECT 'wf_' || CAST(yr AS VARCHAR) AS fold, make_timestamp(1995, 1, 1, 0, 0, 0.0) AS train_start, make_timestamp(yr, 1, 1, 0, 0, 0.0) AS train_end,
    make_timestamp(yr, 1, 2, 0, 0, 0.0) AS validation_start, make_timestamp(yr, 7, 1, 0, 0, 0.0) AS validation_end,
    CASE WHEN yr = 2000 THEN make_timestamp(yr, 6, 1, 0, 0, 0.0) ELSE make_timestamp(yr, 7, 1, 0, 0, 0.0) END AS test_start, make_timestamp(yr, 12, 31, 0, 0, 0.0) AS test_end
  FROM (SELECT DISTINCT year(o_orderdate) AS yr FROM orders) WHERE yr > 1996)"""


def walk_folds(v):
    """Expanding yearly folds from the years present in the data; that of 2000 is broken."""
    yr = F.col("yr")
    ts = lambda m, d: F.make_timestamp(yr, F.lit(m), F.lit(d), F.lit(0), F.lit(0), F.lit(0))
    years = v.table("orders").select(F.year("o_orderdate").alias("yr")).distinct().filter(yr > 1996)
    return years.select(
        F.concat(F.lit("wf_"), yr.cast("string")).alias("fold"),
        F.to_timestamp(F.lit("1995-01-01")).alias("train_start"), ts(1, 1).alias("train_end"),
        ts(1, 2).alias("validation_start"), ts(7, 1).alias("validation_end"),
        F.when(yr == 2000, ts(6, 1)).otherwise(ts(7, 1)).alias("test_start"), ts(12, 31).alias("test_end"),
    )


@query(
    "fold_violations",
    f"WITH {FOLDS_SQL} SELECT fold, 'validation_end must be <= test_start' AS violation FROM folds WHERE validation_end > test_start",
)
def fold_violations(v):
    return O.fold_violations(walk_folds(v)).select("fold", "violation")


@query(
    "fold_membership",
    f"""WITH {FOLDS_SQL} SELECT match_id, fold, 'train' AS part FROM duels JOIN folds ON kickoff_at BETWEEN train_start AND train_end
    UNION ALL SELECT match_id, fold, 'validation' FROM duels JOIN folds ON kickoff_at BETWEEN validation_start AND validation_end
    UNION ALL SELECT match_id, fold, 'test' FROM duels JOIN folds ON kickoff_at BETWEEN test_start AND test_end""",
    ("duels",),
)
def fold_membership(v):
    return O.fold_membership(v.duels.select("match_id", "kickoff_at"), walk_folds(v)).select("match_id", "fold", "part")


@query(
    "fold_overlap",
    f"""WITH {FOLDS_SQL} SELECT fold, count(*) AS n FROM duels JOIN folds ON kickoff_at BETWEEN test_start AND test_end
    AND kickoff_at BETWEEN validation_start AND validation_end GROUP BY fold""",
    ("duels",),
)
def fold_overlap(v):
    from cutline.operators.quality import overlap

    m = O.fold_membership(v.duels.select("match_id", "kickoff_at"), walk_folds(v))
    both = overlap(m.filter("part = 'validation'"), m.filter("part = 'test'"), ["fold", "match_id"])
    return both.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "positional_split",
    """SELECT match_id, pos AS position, CASE WHEN pos <= greatest(1, n // 2) THEN 'train' WHEN pos <= greatest(greatest(1, n // 2) + 1, (n * 3) // 4) THEN 'validation' ELSE 'test' END AS part
    FROM (SELECT match_id, row_number() OVER (ORDER BY kickoff_at, match_id) AS pos, count(*) OVER () AS n FROM results)""",
    ("results",),
)
def positional_split(v):
    return O.positional_split(v.results.select("match_id", "kickoff_at")).select("match_id", "position", "part")


@query(
    "window_of",
    "SELECT match_id, kickoff_at FROM results WHERE kickoff_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'",
    ("results",),
)
def window_of(v):
    ts = lambda s: F.to_timestamp(F.lit(s))
    return O.window_of(v.results, ts("1996-01-01"), ts("1998-12-31")).select("match_id", "kickoff_at")


MIRROR = {
    "swap": [("home_team_id", "away_team_id")], "complement": ["home_advance_probability"], "flip": ["home_advances"],
}


@query(
    "mirror_augment",
    """SELECT match_id, fold, home_team_id, away_team_id, round(home_advance_probability, 6) AS home_advance_probability, home_advances, false AS is_mirror FROM scored
    UNION ALL SELECT match_id, fold, away_team_id, home_team_id, round(1 - home_advance_probability, 6), 1 - home_advances, true FROM scored""",
    ("scored",),
)
def mirror_augment(v):
    s = v.scored.select("match_id", "fold", "home_team_id", "away_team_id", "home_advance_probability", "home_advances")
    return O.mirror_augment(s, **MIRROR)


@query(
    "symmetry_test",
    """SELECT count(*) AS n_pairs, count(*) FILTER (r <= 0.05) AS n_passes, count(*) FILTER (r > 0.05) AS n_fails, round(avg(r), 6) AS mean_abs_residual,
      round(max(r), 6) AS max_abs_residual, 0.05::DOUBLE AS tolerance, count(*) FILTER (r > 0.05) = 0 AS passes
    FROM (SELECT abs(home_advance_probability + coalesce(market_probability, 0.5) - 1) AS r FROM scored)""",
    ("scored",),
)
def symmetry_test(v):
    fwd = v.scored.select("match_id", F.col("home_advance_probability").alias("p"))
    rev = v.scored.select("match_id", F.coalesce("market_probability", F.lit(0.5)).alias("p"))
    return O.symmetry_test(fwd, rev, ["match_id"])


AUDIT = f"""audit AS (
  SELECT match_id, least(home_team_id, away_team_id) AS reference_team_id, CASE WHEN home_team_id <= away_team_id THEN p ELSE 1 - p END AS p_reference,
    CASE WHEN y = 1 THEN home_team_id ELSE away_team_id END AS actual_advancer_id, CASE WHEN p >= 0.5 THEN home_team_id ELSE away_team_id END AS predicted_advancer_id,
    {loss()} AS log_loss_contribution, {brier()} AS brier_contribution
  FROM (SELECT *, home_advance_probability AS p, home_advances AS y FROM scored))"""
AUDIT_SELECT = """SELECT match_id, reference_team_id, round(p_reference, 6) AS p_reference, actual_advancer_id, predicted_advancer_id,
  round(log_loss_contribution, 6) AS log_loss_contribution, round(brier_contribution, 6) AS brier_contribution FROM audit"""
AUDIT_COLS = [
    "match_id", "reference_team_id", "p_reference", "actual_advancer_id", "predicted_advancer_id",
    "log_loss_contribution", "brier_contribution",
]


@query("match_audit", f"WITH {AUDIT} {AUDIT_SELECT}", ("scored",))
def match_audit(v):
    from cutline.plans.report import match_audit as audit

    return audit(v.scored, p="home_advance_probability", y="home_advances").select(*AUDIT_COLS)


@query("worst_matches", f"WITH {AUDIT} {AUDIT_SELECT} ORDER BY audit.log_loss_contribution DESC, match_id LIMIT 30", ("scored",))
def worst_matches(v):
    from cutline.plans.report import match_audit as audit

    return M.worst_rows(audit(v.scored, p="home_advance_probability", y="home_advances"), 30).select(*AUDIT_COLS)


GATE = f"""gf AS (
  SELECT fold, avg({loss()}) AS ll_b, avg({loss('coalesce(mp, 0.5)')}) AS ll_c, avg({brier()}) AS b_b, avg({brier('coalesce(mp, 0.5)')}) AS b_c,
    avg(CAST(p >= 0.62 OR p <= 1 - 0.62 AS DOUBLE)) AS cov_b, avg(CAST(coalesce(mp, 0.5) >= 0.62 OR coalesce(mp, 0.5) <= 1 - 0.62 AS DOUBLE)) AS cov_c,
    CASE WHEN fold <> 'fold_1996' THEN abs(avg(p) - avg(y)) END AS cal_b, abs(avg(coalesce(mp, 0.5)) - avg(y)) AS cal_c FROM {PY} GROUP BY fold),
gate AS (SELECT *, ll_c - 0.01 < ll_b AND b_c - 0.01 < b_b AS challenger_beats FROM gf),
gate2 AS (SELECT *, challenger_beats AND cov_c + 0.15 >= cov_b AND coalesce(cal_c <= cal_b, true) AS meets_threshold FROM gate)"""
GATE_CONFIG = {
    "enabled": True, "min_folds": 2, "min_log_loss_improvement": -0.01, "min_brier_improvement": -0.01,
    "min_coverage_improvement": 0.15,
}


def _gate_input(v):
    s = _py(v)
    mp = F.coalesce("market_probability", F.lit(0.5))
    clear = lambda q: F.avg(((q >= 0.62) | (q <= 1 - 0.62)).cast("double"))
    p = F.col("p")
    return s.groupBy("fold").agg(
        F.avg(P.log_loss_row("p", "y")).alias("log_loss_base"), F.avg(P.log_loss_row(mp, "y")).alias("log_loss_challenger"),
        F.avg(P.brier_row("p", "y")).alias("brier_base"), F.avg(P.brier_row(mp, "y")).alias("brier_challenger"),
        clear(p).alias("coverage_base"), clear(mp).alias("coverage_challenger"),
        F.when(F.col("fold") != "fold_1996", F.abs(F.avg("p") - F.avg("y"))).alias("calibration_base"),
        F.abs(F.avg(mp) - F.avg("y")).alias("calibration_challenger"),
        F.lit(None).cast("double").alias("reliability_base"), F.lit(0.1).alias("reliability_challenger"),
    )


@query("gate_folds", f"WITH {GATE} SELECT fold, challenger_beats, meets_threshold FROM gate2", ("scored",))
def gate_folds(v):
    return O.gate_folds(_gate_input(v), GATE_CONFIG).select("fold", "challenger_beats", "meets_threshold")


@query(
    "gate_decision",
    f"""WITH {GATE} SELECT count(*) AS n_folds_evaluated, count(*) FILTER (meets_threshold) AS n_folds_won, count(*) FILTER (meets_threshold) >= 2 AS becomes_default,
      CASE WHEN count(*) FILTER (meets_threshold) < 2 THEN 'only ' || count(*) FILTER (meets_threshold) || ' of ' || count(*) || ' folds beat the baseline by the required margins (need 2)'
      ELSE 'challenger beats the baseline on ' || count(*) FILTER (meets_threshold) || ' of ' || count(*) || ' folds' END AS reason FROM gate2""",
    ("scored",),
)
def gate_decision(v):
    return O.gate_decision(_gate_input(v), GATE_CONFIG)
