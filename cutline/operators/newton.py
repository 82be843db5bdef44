"""L2 logistic fits of many windows at once, by Newton steps.

A step is one pass over the table for all windows together: tasks add up gradient and curvature of their rows, Spark sums them by window, and
the driver solves one small system for each. Nothing is searched along a line: a step that made a window's loss worse is halved. Rows travel to
the tasks' Python as raw values, once for all windows; imputation and standardisation are a window's own and done there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest gradient of the mean loss that counts as none, and steps before a fit fails.
SETTLED, STEPS = 1e-10, 100


@dataclass(frozen=True)
class Inputs:
    """How tasks make features of raw values: for each the raw column (-1: there is none), whether it is that column's missing indicator, and what
    fills, centres and scales it. Nulls and NaN are missing."""

    column: np.ndarray
    missing: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        raw = np.column_stack([x, np.full(len(x), np.nan)])[:, self.column]
        gone = np.isnan(raw)
        return (np.where(self.missing, gone, np.where(gone, self.fill, raw)) - self.mean) / self.scale


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and nulls of an Arrow column of equally long lists of doubles."""
    flat = column.flatten()
    shape = (len(column), len(flat) // max(1, len(column)))
    return flat.to_numpy(zero_copy_only=False).reshape(shape), flat.is_null().to_numpy(zero_copy_only=False).reshape(shape)


@dataclass(frozen=True)
class Problem:
    """A window of rows with its own features, weights and penalty |b|^2 / (2 C); the intercept is not penalised. With ``inputs`` the features are
    made of ``features`` by them."""

    member: Column
    features: list[Column]
    label: Column
    weight: Column
    C: float = 1.0
    inputs: Inputs | None = None

    @property
    def size(self) -> int:
        return len(self.features if self.inputs is None else self.inputs.column)


@dataclass
class Linear:
    coefficients: DenseVector
    intercept: float
    steps: int = 0
    gradient: float = 0.0

    def margin(self, features: list[Column]) -> Column:
        terms = [F.lit(float(b)) * x for b, x in zip(self.coefficients, features, strict=True)]
        return sum(terms, F.lit(float(self.intercept)))

    def probability(self, features: list[Column]) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin(features)))

    def as_dict(self) -> dict:
        return {"coefficients": [float(b) for b in self.coefficients], "intercept": float(self.intercept)}

    @staticmethod
    def of(kept: dict) -> Linear:
        return Linear(DenseVector(kept["coefficients"]), kept["intercept"])


def _sums(at: dict[int, np.ndarray], spans: dict[int, tuple[int, int]], inputs: dict[int, Inputs | None]):
    """Per window: loss, weight, weighted labels, gradient and the upper half of the curvature at the coefficients ``at``."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, null = matrix(batch.column("x"))
            (y, no_y), (w, no_w) = matrix(batch.column("y")), matrix(batch.column("w"))
            for j, (i, b) in enumerate(at.items()):
                own = slice(*spans[i])
                ok = ~(no_w[:, j] | no_y[:, j])
                if inputs[i] is None:
                    ok &= ~null[:, own].any(axis=1)
                if not ok.any():
                    continue
                z = x[ok, own] if inputs[i] is None else inputs[i].of(x[ok, own])
                z = np.column_stack([z, np.ones(len(z))])
                m = z @ b
                yi, wi = y[ok, j], w[ok, j]
                p = 1.0 / (1.0 + np.exp(-m))
                loss = wi @ (np.logaddexp(0.0, m) - yi * m)
                bend = (z * (wi * p * (1.0 - p))[:, None]).T @ z
                found = np.concatenate([[loss, wi.sum(), wi @ yi], z.T @ (wi * (p - yi)), bend[np.triu_indices(len(b))]])
                total[i] = total[i] + found if i in total else found
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["i", "s"]
            )

    return run


def newton(rows: DataFrame, problems: dict, settled: float = SETTLED, steps: int = STEPS) -> dict:
    """A ``Linear`` for each problem. Rows with a null feature or label take no part; a window of one class has coefficients of zero and an infinite
    intercept, an empty one is all zero. ``rows`` should be a stored table: every step reads it."""
    names = list(problems)
    at = {i: np.zeros(problems[n].size + 1) for i, n in enumerate(names)}
    # windows that share a list of features share its values
    lists = {id(problems[n].features): problems[n].features for n in names}
    starts, end = {}, 0
    for k, f in lists.items():
        starts[k], end = end, end + len(f)
    spans = {i: (starts[id(problems[n].features)], starts[id(problems[n].features)] + len(problems[n].features)) for i, n in enumerate(names)}
    raw = F.array(*[c.cast("double") for f in lists.values() for c in f])
    before: dict[int, tuple[float, np.ndarray]] = {}
    done: dict[int, Linear] = {}
    for turn in range(1, steps + 1):
        todo = [i for i in at if i not in done]
        if not todo:
            break
        own = [problems[names[i]] for i in todo]
        each = rows.where(reduce(or_, [F.coalesce(p.member, F.lit(False)) for p in own])).select(
            raw.alias("x"), F.array(*[p.label.cast("double") for p in own]).alias("y"), F.array(*[F.when(p.member, p.weight.cast("double")) for p in own]).alias("w")
        )
        found = each.mapInArrow(_sums({i: at[i] for i in todo}, spans, {i: p.inputs for i, p in zip(todo, own, strict=True)}), "i int, s array<double>")
        found = found.groupBy("i").agg(Summarizer.sum(array_to_vector("s")).alias("s")).select("i", vector_to_array("s").alias("s"))
        sums = {r["i"]: np.array(r["s"]) for r in found.collect()}
        for i in todo:
            d = len(at[i]) - 1
            if i not in sums:
                done[i] = Linear(DenseVector([0.0] * d), 0.0)
                continue
            loss, weight, ones = sums[i][:3]
            if ones <= 0 or ones >= weight * (1 - 1e-15):
                done[i] = Linear(DenseVector([0.0] * d), -math.inf if ones <= 0 else math.inf, turn)
                continue
            penalty = np.r_[np.full(d, 1.0 / problems[names[i]].C), 0.0]
            loss += 0.5 * (penalty * at[i] ** 2).sum()
            slope = sums[i][3 : 4 + d] + penalty * at[i]
            if np.abs(slope).max() <= settled * weight:
                done[i] = Linear(DenseVector(at[i][:d]), float(at[i][d]), turn, float(np.abs(slope).max() / weight))
                continue
            if i in before and loss > before[i][0] + 1e-12 * abs(loss):
                at[i] = 0.5 * (at[i] + before[i][1])
                continue
            bend = np.zeros((d + 1, d + 1))
            bend[np.triu_indices(d + 1)] = sums[i][4 + d :]
            bend = bend + np.triu(bend, 1).T + np.diag(penalty)
            before[i] = loss, at[i]
            at[i] = at[i] - np.linalg.solve(bend, slope)
    if len(done) < len(names):
        raise RuntimeError(f"logistic fit did not settle in {steps} steps")
    return {n: done[i] for i, n in enumerate(names)}
