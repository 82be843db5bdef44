"""Probability models on ``pyspark.ml``.

Fits run on distributed frames, all windows of a backtest in the same passes; the driver holds only coefficients and per-column statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions import probability as P
from cutline.operators.isotonic import isotonic_blocks, isotonic_values
from cutline.operators.newton import Inputs, Linear, Problem, newton
from cutline.operators.windows import window_medians, window_moments

MEDIAN_BRACKET_ROWS = 1_000_000
MIN_TRAIN_ROWS = 64


# -- preprocessing ---------------------------------------------------------------------------

def number(c: str) -> Column:
    """Column as double with NaN turned into null."""
    d = F.col(c).cast("double")
    return F.when(~F.isnan(d), d)


def add_missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """``{c}_isna`` for every feature, also for those never missing."""
    todo = [c for c in columns if not c.endswith("_isna") and f"{c}_isna" not in df.columns]
    return df.withColumns({f"{c}_isna": number(c).isNull().cast("int") for c in todo}) if todo else df


def exact_medians(df: DataFrame, columns: list[str], bracket_rows: int = MEDIAN_BRACKET_ROWS) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values) of many columns.

    Approximate quantiles bracket the middle; each pass shrinks the bracket by orders of magnitude
    until few rows remain in it, and only those are counted by value. The driver sees a few
    numbers per column.
    """
    if not columns:
        return {}
    vals = df.select(*[number(c).alias(c) for c in columns])
    n = vals.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    lo: dict[str, float | None] = {c: None for c in columns}
    hi: dict[str, float | None] = {c: None for c in columns}
    below = {c: 0 for c in columns}
    size = dict(n)

    def inside(c: str) -> Column:
        ok = F.col(c).isNotNull()
        if lo[c] is not None:
            ok = ok & (F.col(c) >= lo[c]) & (F.col(c) <= hi[c])
        return ok

    while True:
        wide = [c for c in columns if size[c] > bracket_rows and (lo[c] is None or lo[c] < hi[c])]
        if not wide:
            break
        asks = []
        for c in wide:
            mid = (n[c] / 2.0 - below[c]) / size[c]
            shares = F.array(F.lit(max(0.0, mid - 4e-4)), F.lit(min(1.0, mid + 4e-4)))
            asks.append(F.percentile_approx(F.when(inside(c), F.col(c)), shares, F.lit(10000)).alias(c))
        found = vals.agg(*asks).first().asDict()
        before = {c: size[c] for c in wide}
        for c in wide:
            lo[c], hi[c] = found[c]
        counts = vals.agg(
            *[F.count_if(F.col(c) < lo[c]).alias(f"b_{c}") for c in wide],
            *[F.count_if(inside(c)).alias(f"s_{c}") for c in wide],
        ).first().asDict()
        for c in wide:
            below[c], size[c] = counts[f"b_{c}"], counts[f"s_{c}"]
        if all(size[c] >= before[c] for c in wide):
            break

    pairs = F.array(*[
        F.when(inside(c), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, c in enumerate(columns)
    ])
    tall = vals.select(F.explode(F.array_compact(pairs)).alias("s")).groupBy("s.i", "s.v").count()
    w = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = tall.withColumn("upto", F.sum("count").over(w))
    ranks = df.sparkSession.createDataFrame(
        [(i, r - below[c]) for i, c in enumerate(columns) for r in {(n[c] + 1) // 2, n[c] // 2 + 1} if n[c]],
        "i int, r long",
    ) if any(n.values()) else None
    out: dict[str, float | None] = {c: None for c in columns}
    if ranks is None:
        return out
    hit = upto.join(F.broadcast(ranks), "i").filter(
        (F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("count") < F.col("r"))
    )
    for row in hit.groupBy("i").agg(F.avg("v").alias("m")).collect():
        out[columns[row["i"]]] = row["m"]
    return out


@dataclass
class Scaling:
    """Training-only medians, means and population deviations of the kept columns."""

    columns: list[str] = field(default_factory=list)
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def standardised(self, have: set[str]) -> list[Column]:
        """Imputed and standardised columns; a column that is not there counts as missing, an indicator is worked out from its column."""
        cols = []
        for c in self.columns:
            if c in have:
                raw = number(c)
            elif c.endswith("_isna"):
                raw = number(c.removesuffix("_isna")).isNull().cast("double") if c.removesuffix("_isna") in have else F.lit(None).cast("double")
            else:
                raw = F.lit(None).cast("double")
            cols.append((F.coalesce(raw, F.lit(self.median[c])) - self.mean[c]) / self.scale[c])
        return cols

    def inputs(self, have: list[str]) -> Inputs:
        """The same features, made of the columns ``have`` in tasks."""
        at = {c: k for k, c in enumerate(have)}
        base = [at.get(c, at.get(c.removesuffix("_isna"), -1) if c.endswith("_isna") else -1) for c in self.columns]
        missing = [c not in at and k >= 0 for c, k in zip(self.columns, base, strict=True)]
        numbers = (np.array([d[c] for c in self.columns], float) for d in (self.median, self.mean, self.scale))
        return Inputs(np.array(base, int), np.array(missing, bool), *numbers)

    def apply(self, df: DataFrame) -> DataFrame:
        """Impute and standardise into ``features``; a column the frame lacks counts as missing."""
        cols = [z.alias(f"_z_{c}") for z, c in zip(self.standardised(set(df.columns)), self.columns, strict=True)]
        keep = [c for c in df.columns if c != "features"]
        ready = df.select(*keep, *cols)
        out = VectorAssembler(inputCols=[f"_z_{c}" for c in self.columns], outputCol="features").transform(ready)
        return out.drop(*[f"_z_{c}" for c in self.columns])


def fit_scalings(rows: DataFrame, columns: list[str], members: dict[str, Column]) -> dict[str, Scaling]:
    """``fit_scaling`` of many windows in the passes of one: a window's rows are those where its condition holds. Indicators of columns are worked out
    from these, so that a frame need not have them."""
    have = set(rows.columns)
    plain = [c for c in columns if c in have]
    of = {c: c.removesuffix("_isna") for c in columns if c not in have}
    values, conditions = [F.col(c).cast("double") for c in plain], list(members.values())
    at = {c: k for k, c in enumerate(plain)}
    medians = window_medians(rows, values, conditions)
    # an indicator that is a column of the frame is filled by 0 like those worked out here
    medians |= {(j, at[c]): 0.0 for c in plain if c.endswith("_isna") for j in range(len(conditions))}
    moments = window_moments(rows, values, conditions, medians)
    out = {}
    for j, w in enumerate(members):
        if j not in moments:
            out[w] = Scaling()
            continue
        _, gone, mean, spread = moments[j]
        found: dict[str, tuple[float, float, float]] = {}
        for c in columns:
            if c in at:
                if medians[j, at[c]] is not None:
                    found[c] = float(medians[j, at[c]]), float(mean[at[c]]), float(spread[at[c]])
            else:
                share = float(gone[at[of[c]]])
                found[c] = 0.0, share, math.sqrt(share * (1.0 - share))
        # a constant column keeps scale 1, also when rounding leaves a trace of variance
        scale = {c: x if x > 1e-12 * max(1.0, abs(m)) else 1.0 for c, (_, m, x) in found.items()}
        out[w] = Scaling(list(found), {c: f[0] for c, f in found.items()}, {c: f[1] for c, f in found.items()}, scale)
    return out


def fit_scaling(train: DataFrame, columns: list[str]) -> Scaling:
    """Exact median imputation, then mean and ddof-0 deviation of the imputed columns.

    Columns without any value are dropped by name, so names and coefficients stay aligned.
    """
    medians: dict[str, float | None] = {c: 0.0 for c in columns if c.endswith("_isna")}
    medians |= exact_medians(train, [c for c in columns if c not in medians])
    kept = [c for c in columns if medians[c] is not None]
    filled = train.select(*[F.coalesce(number(c), F.lit(medians[c])).alias(f"_z_{i}") for i, c in enumerate(kept)])
    vectors = VectorAssembler(inputCols=filled.columns, outputCol="v").transform(filled)
    stats = vectors.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    n = int(stats["count"])
    spread = [math.sqrt(float(x) * (n - 1) / n) for x in stats["variance"]]
    return Scaling(
        kept,
        {c: float(medians[c]) for c in kept},
        {c: float(stats["mean"][i]) for i, c in enumerate(kept)},
        # a constant column keeps scale 1, also when rounding leaves a trace of variance
        {c: spread[i] if spread[i] > 1e-12 * max(1.0, abs(stats["mean"][i])) else 1.0 for i, c in enumerate(kept)},
    )


# -- logistic baseline -----------------------------------------------------------------------

@dataclass(frozen=True)
class LogisticConfig:
    C: float = 1.0
    max_iter: int = 1000
    balanced: bool = False
    missing_indicators: bool = True


def _p1(scored: DataFrame, out: str) -> DataFrame:
    return scored.withColumn(out, vector_to_array("_prob")[1]).drop("_prob", "_raw", "_pred", "features")


@dataclass
class LogisticModel:
    scaling: Scaling
    model: Linear
    columns: list[str]
    config: LogisticConfig
    train_rows: int

    def probability(self, have: list[str]) -> Column:
        """P(label) as a column of a frame with the columns ``have``."""
        return window_probability({"": self}, have, F.lit(""))

    def predict(self, df: DataFrame, out: str = "base_probability") -> DataFrame:
        return df.withColumn(out, self.probability(df.columns))

    def importance(self) -> list[tuple[str, float]]:
        """(feature, coefficient), largest absolute value first."""
        pairs = zip(self.scaling.columns, self.model.coefficients.toArray().tolist(), strict=True)
        return sorted(pairs, key=lambda x: -abs(x[1]))


def window_probability(models: dict[str, LogisticModel], have: list[str], window: Column) -> Column:
    """P(label) of each row by the model that ``window`` names, null where it names none. The rows' values go to Python once for all models."""
    wanted = {c for m in models.values() for c in m.scaling.columns}
    wanted |= {c.removesuffix("_isna") for c in wanted}
    columns = [c for c in have if c in wanted]
    parts = [(w, m.scaling.inputs(columns), np.array([*m.model.coefficients, m.model.intercept])) for w, m in models.items()]

    def score(x: pa.Array, w: pa.Array) -> pa.Array:
        from cutline.operators.newton import matrix

        values, _ = matrix(x)
        names = w.to_numpy(zero_copy_only=False)
        out = np.full(len(names), np.nan)
        for name, inputs, b in parts:
            own = names == name
            if own.any():
                with np.errstate(over="ignore"):
                    out[own] = 1.0 / (1.0 + np.exp(-(inputs.of(values[own]) @ b[:-1] + b[-1])))
        return pa.array(out, pa.float64(), mask=np.isin(names, list(models), invert=True))

    return F.arrow_udf(score, "double")(F.array(*[F.col(c).cast("double") for c in columns]) if columns else F.array().cast("array<double>"), window)


def fit_logistics(
    rows: DataFrame, columns: list[str], members: dict[str, Column], label: str = "home_advances", config: LogisticConfig | None = None
) -> dict[str, LogisticModel]:
    """A model for each window of a stored table, a window's rows being those where its condition holds: all windows are fitted in the same passes."""
    cfg = config or LogisticConfig()
    y, cols = F.col(label).cast("double"), list(columns)
    if cfg.missing_indicators:
        cols += [f"{c}_isna" for c in columns if not c.endswith("_isna")]
    asks = [e for i, m in enumerate(members.values()) for e in (F.count(F.when(m, y)).alias(f"n{i}"), F.sum(F.when(m, y)).alias(f"k{i}"))]
    counts = rows.agg(*asks).first()
    scalings = fit_scalings(rows, cols, members)
    # all windows share the raw values
    have = [c for c in rows.columns if c in cols]
    raw = [F.col(c).cast("double") for c in have]
    problems, size = {}, {}
    for i, (w, member) in enumerate(members.items()):
        n, k = int(counts[f"n{i}"]), float(counts[f"k{i}"] or 0.0)
        weight = F.lit(1.0)
        if cfg.balanced and 0 < k < n:
            weight = F.when(y == 1.0, n / (2.0 * k)).otherwise(n / (2.0 * (n - k)))
        problems[w], size[w] = Problem(member, raw, y, weight, cfg.C, scalings[w].inputs(have)), n
    fits = newton(rows, problems, steps=cfg.max_iter)
    return {w: LogisticModel(scalings[w], fits[w], list(columns), cfg, size[w]) for w in members}


def fit_logistic(
    train: DataFrame, columns: list[str], label: str = "home_advances", config: LogisticConfig | None = None
) -> LogisticModel:
    """L2 logistic with an unpenalised intercept: sum of losses + |w|^2 / (2 C)."""
    return fit_logistics(train, columns, {"": F.lit(True)}, label, config)[""]


# -- boosted trees ---------------------------------------------------------------------------

@dataclass(frozen=True)
class BoostConfig:
    iterations: int = 500
    learning_rate: float = 0.05
    depth: int = 6
    early_stop_tol: float = 0.01
    seed: int = 42


@dataclass
class BoostModel:
    scaling: Scaling
    model: object
    columns: list[str]
    indexers: list = field(default_factory=list)

    def _prepare(self, df: DataFrame) -> DataFrame:
        for ix in self.indexers:
            df = ix.transform(df)
        return self.scaling.apply(add_missing_indicators(df, [c for c in self.columns if c in df.columns]))

    def predict(self, df: DataFrame, out: str = "base_probability") -> DataFrame:
        scored = _p1(self.model.transform(self._prepare(df)), out)
        return scored.select(*df.columns, out)

    def importance(self) -> list[tuple[str, float]]:
        pairs = zip(self.scaling.columns, self.model.featureImportances.toArray().tolist(), strict=True)
        return sorted(pairs, key=lambda x: -x[1])


def fit_boosted(
    train: DataFrame,
    validation: DataFrame | None,
    columns: list[str],
    label: str = "home_advances",
    config: BoostConfig | None = None,
    categorical: list[str] = (),
) -> BoostModel:
    """Gradient-boosted trees, early-stopped on the validation rows.

    Missing values become median plus indicator; categories are indexed by frequency.
    """
    cfg = config or BoostConfig()
    indexers, cols = [], [c for c in columns if c not in categorical]
    rows = train.withColumn("_val", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(validation.withColumn("_val", F.lit(True)))
    for c in categorical:
        ix = StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep").fit(train)
        indexers.append(ix)
        rows, cols = ix.transform(rows), [*cols, f"{c}_ix"]
    rows = add_missing_indicators(rows, cols).withColumn("_y", F.col(label).cast("double"))
    names = cols + [f"{c}_isna" for c in cols]
    scaling = fit_scaling(rows.filter(~F.col("_val")), names)
    gbt = GBTClassifier(
        featuresCol="features", labelCol="_y", maxIter=cfg.iterations, stepSize=cfg.learning_rate,
        maxDepth=cfg.depth, seed=cfg.seed, validationTol=cfg.early_stop_tol, predictionCol="_pred",
    ).setProbabilityCol("_prob").setRawPredictionCol("_raw")
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol("_val")
    return BoostModel(scaling, gbt.fit(scaling.apply(rows)), cols, indexers)


def select_base_learner(enabled: bool, n_train: int, n_validation: int, min_train: int = 200) -> tuple[str, str]:
    """(learner, reason): boosted trees only when enabled and enough data exists."""
    if not enabled:
        return "logistic", "boosted_disabled_in_config"
    if n_train < min_train:
        return "logistic", f"n_train={n_train} < {min_train}"
    if n_validation < 1:
        return "logistic", "no_validation_examples"
    return "boosted", "enabled"


# -- stacking and calibration ----------------------------------------------------------------

STACK_INPUTS = ("market_probability", "elo_probability", "base_probability")


def filled_market() -> Column:
    m, e, b = (F.col(c) for c in STACK_INPUTS)
    return F.coalesce(m, 0.5 * (e + b))


@dataclass
class Stacker:
    method: str = "logistic"
    model: object = None
    weights: tuple[float, float, float] = (0.5, 0.1, 0.4)

    def predict(self, df: DataFrame, out: str = "stacked_probability") -> DataFrame:
        if self.method == "weighted_blend":
            return df.withColumn(out, P.weighted_blend(filled_market(), "elo_probability", "base_probability", self.weights))
        return df.withColumn(out, self.probability())

    def probability(self) -> Column:
        return self.model.probability(_stack_features())


def _stack_features() -> list[Column]:
    return [filled_market(), *(F.col(c) for c in STACK_INPUTS[1:])]


def fit_stackers(df: DataFrame, members: dict[str, Column], label: str = "home_advances", method: str = "logistic", C: float = 1.0,
                 max_iter: int = 1000, weights=(0.5, 0.1, 0.4)) -> dict[str, Stacker]:
    """A stacker for each window: market, rating and base probabilities combined; a null market is the mean of the others."""
    if method == "weighted_blend":
        return {w: Stacker(method, None, tuple(weights)) for w in members}
    if method != "logistic":
        raise ValueError(f"Unknown stacking method: {method}")
    y, x = F.col(label).cast("double"), _stack_features()
    fits = newton(df, {w: Problem(m, x, y, F.lit(1.0), C) for w, m in members.items()}, steps=max_iter)
    return {w: Stacker(method, fits[w]) for w in members}


def fit_stacker(df: DataFrame, label: str = "home_advances", method: str = "logistic", C: float = 1.0,
                max_iter: int = 1000, weights=(0.5, 0.1, 0.4)) -> Stacker:
    return fit_stackers(df, {"": F.lit(True)}, label, method, C, max_iter, weights)[""]


@dataclass
class Calibrator:
    """One map of probabilities, or one for each value of ``keys``: an isotonic fit is a table of blocks."""

    method: str
    model: object
    keys: tuple[str, ...] = ()

    def predict(self, df: DataFrame, p: str = "stacked_probability", out: str = "calibrated_probability") -> DataFrame:
        if self.method == "isotonic":
            return isotonic_values(df, self.model, list(self.keys), p, "_iso").withColumn(out, P.clip("_iso")).drop("_iso")
        return df.withColumn(out, P.clip(self.model.probability([P.logit(p)])))


def fit_calibrator(df: DataFrame, p: str = "stacked_probability", label: str = "home_advances",
                   method: str = "isotonic", C: float = 1.0, max_iter: int = 1000, keys: tuple[str, ...] = ()) -> Calibrator:
    """Isotonic (clipped outside the fitted range; one for each value of ``keys``) or Platt calibration."""
    if method == "isotonic":
        return Calibrator(method, isotonic_blocks(df, list(keys), p, label), tuple(keys))
    if method == "platt":
        y = F.col(label).cast("double")
        return Calibrator(method, newton(df, {"": Problem(F.lit(True), [P.logit(p)], y, F.lit(1.0), C)}, steps=max_iter)[""])
    raise ValueError(f"Unknown calibration method: {method}")


def importance_table(spark, pairs: list[tuple[str, float]], top: int | None = None) -> DataFrame:
    """Ranked (feature, importance): one row per model column."""
    rows = [(i + 1, name, float(v)) for i, (name, v) in enumerate(pairs)]
    return spark.createDataFrame(rows[:top] if top else rows, "rank int, feature string, importance double")
