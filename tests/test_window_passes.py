"""Statistics and scores of many columns in many windows: exact, and worked out on values in tasks instead of by an expression for each column."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import models as K
from cutline.operators.isotonic import isotonic_blocks, isotonic_values
from cutline.operators.newton import Linear
from cutline.operators.windows import window_medians, window_moments


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 7, 10_000])
def test_medians_and_moments_equal_numpy(spark, few):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=301), rng.integers(-2, 3, 301), np.exp(rng.normal(size=301) * 40), np.full(301, 0.1), np.full(301, np.nan)])
    x[rng.random(301) < 0.2, 0] = np.nan
    rows = spark.createDataFrame([(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    members, own = [F.col("id") < 200, F.col("id") >= 150, F.col("id") > 900], [np.arange(301) < 200, np.arange(301) >= 150]
    columns = [F.col(c) for c in "abcde"]
    found = window_medians(rows, columns, members, few)
    moments = window_moments(rows, columns, members, found)
    assert set(moments) == {0, 1} and all(found[2, c] is None for c in range(5))
    for j, rows_of in enumerate(own):
        part = x[rows_of]
        n, gone, mean, spread = moments[j]
        assert n == len(part) and found[j, 4] is None
        for c in range(4):
            median = np.nanmedian(part[:, c])
            assert found[j, c] == median
            filled = np.where(np.isnan(part[:, c]), median, part[:, c])
            assert gone[c] == pytest.approx(np.isnan(part[:, c]).mean())
            assert mean[c] == pytest.approx(filled.mean()) and spread[c] == pytest.approx(filled.std(), rel=1e-9, abs=1e-12)


def test_scores_of_many_features_are_one_call(spark):
    n = 40
    names = [f"f{i}" for i in range(n)]
    df = spark.range(30).select("id", *[F.when((F.col("id") + i) % 5 != 0, (F.col("id") * (i + 3)) % 11 * 1.0).alias(c) for i, c in enumerate(names)])
    cols = [*names, *[f"{c}_isna" for c in names], "absent"]
    scaling = K.Scaling(cols, dict.fromkeys(cols, 0.5), dict.fromkeys(cols, 0.25), dict.fromkeys(cols, 2.0))
    model = K.LogisticModel(scaling, Linear(np.linspace(-0.3, 0.4, len(cols)), 0.1), names, K.LogisticConfig(), 1)
    out = model.predict(df, "p")
    assert plan(out).count("isnan") == 0 and plan(out).count("EXP") == 0
    want = df.select("id", model.model.probability(scaling.standardised(set(df.columns))).alias("p"))
    assert {r["id"]: pytest.approx(r["p"], abs=1e-12) for r in want.collect()} == {r["id"]: r["p"] for r in out.collect()}


@pytest.mark.parametrize("few", [0, 20_000])
def test_few_blocks_are_looked_up_without_a_join(spark, few):
    rows = [(k, i / 50, float((i * 7 + 3 * ord(k[0])) % 13 < 6 + i // 10)) for k in ("a", "b") for i in range(50)] + [(None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    blocks = isotonic_blocks(df, ["k"], "x", "y")
    ask = spark.createDataFrame([(k, i / 37 - 0.1) for k in ("a", "b", None, "other") for i in range(50)] + [("a", None), ("a", float("nan"))], "k string, x double")
    found, join = isotonic_values(ask, blocks, ["k"], "x", "v", few=few), isotonic_values(ask, blocks, ["k"], "x", "v", few=0)
    assert few == 0 or "Join" not in plan(found)
    key = lambda r: (r["k"] or "", str(r["x"]))
    for a, b in zip(sorted(found.collect(), key=key), sorted(join.collect(), key=key), strict=True):
        assert key(a) == key(b) and (a["v"] is None) == (b["v"] is None)
        assert a["v"] is None or a["v"] == pytest.approx(b["v"], abs=1e-12)
