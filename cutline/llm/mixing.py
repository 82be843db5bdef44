"""Mixing to target weights with soft membership (operator 8).

A classifier learnt from the labelled table gives every document a posterior over domains (quality x toxicity). Rates, the
number of times a document is to be seen, are then fitted by projected-gradient least squares so that the expected domain
totals, sum of rate x tokens x posterior, meet the target weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import fresh, stored, words_in

DOMAINS = ("poor", "poor_toxic", "clean", "clean_toxic")  # index: 2 * quality + toxic
#: Fitting: labelled texts per domain, characters looked at in one text (passages over the whole of it), features kept.
SAMPLE, PASSAGE, FEATURES = 1000, 32768, 512
BUCKET_BITS = 18
ROUND = 1 << 19
#: Projected gradient: the residual (as a part of all tokens) at which it stops, the most by which a plain step may still move a rate at a
#: bounded optimum, and the steps after which a fit that has reached neither is an error.
STEPS, ENOUGH, SETTLED = 400, 1e-4, 1e-3
#: Steps after which the rates are written, so that no row replays more than these in one pass.
REPLAYED = 8
#: No upper bound on the rates, unless the caller sets one.
MOST_REPEATS = math.inf
#: Equal shares, whatever mix the tables have.
TARGETS = {"clean": 0.25, "clean_toxic": 0.25, "poor": 0.25, "poor_toxic": 0.25}

_rng = np.random.default_rng(11)
_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_KIND = np.full(256, 2, np.uint8)  # 2: marks, 1: letters, digits and bytes over 127, 0: white space
_KIND[128:] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[32, *range(9, 14)]] = 0


def _buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and first byte of every word and every run of marks."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    size = np.diff(np.concatenate((edge, [len(raw)])))
    place = np.minimum(np.arange(len(raw)) - np.repeat(edge, size), 63)
    h = np.add.reduceat(_VALUE[_LOWER[raw]] * _PLACE[place], edge)
    real = kind[edge] > 0
    h = (h[real] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    return h.astype(np.int64), edge[real]


@dataclass
class Classifier:
    column: np.ndarray  # bucket -> feature or -1
    weights: np.ndarray  # features + 1 x domains, the last row the bias

    def posteriors(self, texts) -> np.ndarray:
        texts = list(texts)
        counts = np.zeros((len(texts), len(self.weights) - 1))
        group: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if not group:
                return
            data = b" ".join(d for _, d in group) + b" "
            starts = np.cumsum([0] + [len(d) + 1 for _, d in group[:-1]])
            buckets, at = _buckets(data)
            col = self.column[buckets]
            doc = np.array([i for i, _ in group])[np.searchsorted(starts, at, "right") - 1]
            hit = col >= 0
            np.add.at(counts, (doc[hit], col[hit]), 1)
            group.clear()

        for i, t in enumerate(texts):
            for piece in _pieces((t or "").encode("utf-8", "surrogatepass")):
                if size + len(piece) > ROUND:
                    flush()
                    size = 0
                group.append((i, piece))
                size += len(piece) + 1
        flush()
        return _softmax(np.log1p(counts) @ self.weights[:-1] + self.weights[-1])


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a space, where one is near."""
    at = 0
    while at < len(data):
        end = min(len(data), at + ROUND)
        if end < len(data):
            gap = data.rfind(b" ", at + 1, end)
            end = gap if gap > 0 else end
        yield data[at:end]
        at = end


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_classifier(texts: list[str | None], domain: list[int], share: np.ndarray) -> Classifier:
    """Softmax regression on the log counts of the words whose presence differs most between a domain and the rest.
    ``share``: part of each domain among all labelled rows (zeros for one that has none); the bias is moved to it."""
    y, d = np.array(domain, int), len(DOMAINS)
    share = np.maximum(share, 1e-6)
    prior = np.log(share / share.sum())
    column = np.full(1 << BUCKET_BITS, -1, np.int64)
    if len(np.unique(y)) < 2:
        return Classifier(column, prior[None, :])
    seen = [np.unique(_buckets((t or "").encode("utf-8", "surrogatepass") + b" ")[0]) for t in texts]
    present = np.stack([
        np.bincount(np.concatenate([s for s, k in zip(seen, y, strict=True) if k == c] or [np.empty(0, np.int64)]), minlength=1 << BUCKET_BITS) for c in range(d)
    ]).astype(float)
    n = np.bincount(y, minlength=d).astype(float)[:, None]
    rest, m = present.sum(0) - present, n.sum() - n
    p, q = (present + 0.5) / (n + 1), (rest + 0.5) / (m + 1)
    z = np.abs(p - q) / np.sqrt(p * (1 - p) / (n + 1) + q * (1 - q) / (m + 1))
    z[n[:, 0] == 0] = 0
    best = np.argsort(-z.max(0), kind="stable")[:FEATURES]
    best = best[z.max(0)[best] > 3]
    column[best] = np.arange(len(best))
    model = Classifier(column, np.zeros((len(best) + 1, d)))
    x = np.zeros((len(y), len(best)))
    for i, t in enumerate(texts):
        col = column[_buckets((t or "").encode("utf-8", "surrogatepass") + b" ")[0]]
        x[i] = np.bincount(col[col >= 0], minlength=len(best))
    x = np.hstack((np.log1p(x), np.ones((len(y), 1))))
    truth = np.eye(d)[y]
    w = model.weights
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 401):
        g = x.T @ (_softmax(x @ w) - truth) / len(y) + 1e-4 * w
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    here = np.maximum(np.bincount(y, minlength=d) / len(y), 1e-6)
    w[-1] += prior - np.log(here)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled texts of each domain, those with the smallest hashes of their ids; shares come
    from all labelled rows. Rows with a null label, or labels other than 0 and 1, are left aside."""
    known = labels.where("quality in (0, 1) and toxic in (0, 1)").select("doc_id", (2 * F.col("quality") + F.col("toxic")).cast("int").alias("y")).distinct()
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = np.array([totals.get(k, 0) for k in range(len(DOMAINS))], float)
    if not share.sum():
        return Classifier(np.full(1 << BUCKET_BITS, -1, np.int64), np.log(np.full((1, len(DOMAINS)), 1 / len(DOMAINS))))
    picked = None
    for y in totals:
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    small = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in picked.collect()], "doc_id long, y int")
    text, n = F.coalesce(F.col("text"), F.lit("")), F.length("text")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(text, (F.lit(1) + F.floor(i * n / 16)).cast("int"), F.lit(PASSAGE // 16))), " ")
    chosen = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").select("doc_id", "y", F.when(n > PASSAGE, spread).otherwise(text).alias("t"))
    got = chosen.groupBy("doc_id", "y").agg(F.min("t").alias("t")).orderBy("doc_id", "y").collect()
    return fit_classifier([r["t"] for r in got], [r["y"] for r in got], share)


def posteriors(model: Classifier, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model.posteriors(s)))

    return of(text)


def _replay(p: Column, state: Column, steps: list[tuple[list[float], float]], floor: float, ceil: float) -> Column:
    """struct<r, y>: the rate and the point ahead of it that the next gradient is taken at, after the given steps. Both depend on
    the posterior alone, so they are worked out again rather than kept with the documents."""
    if not steps:
        return state
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in (*g, beta)]) for g, beta in steps])

    def step(s: Column, m: Column) -> Column:
        r = F.greatest(F.lit(float(floor)), F.least(F.lit(float(ceil)), s["y"] - sum(p[k] * m[k] for k in range(len(DOMAINS)))))
        return F.struct(r.alias("r"), (r + m[len(DOMAINS)] * (r - s["r"])).alias("y"))

    return F.aggregate(moves, state, step)


def _start(floor: float, ceil: float) -> Column:
    one = F.lit(min(max(1.0, floor), ceil))
    return F.struct(one.alias("r"), one.alias("y"))


@dataclass
class Fit:
    steps: list[tuple[list[float], float]]
    floor: float
    ceil: float
    wanted: dict[str, float]
    reached: dict[str, float]

    def rate(self, p: Column) -> Column:
        return _replay(p, _start(self.floor, self.ceil), self.steps, self.floor, self.ceil)["r"]


def fit_rates(members: DataFrame, targets: dict[str, float], floor: float = 0.0, ceil: float = MOST_REPEATS, keep_total: bool = True) -> Fit:
    """``members`` has tokens and p (posterior). Every step is one grouped sum over all rows; the driver sees a handful of sums.

    The residual is weighted with the inverse of sum(tokens p p'), for which a step of length one cannot overshoot, and the
    step is taken in units of each row's own tokens, so that rows with equal posteriors get equal rates whatever their length.
    Steps are accelerated: each gradient is taken a little ahead of the rates, in the direction of their last change.
    ``keep_total``: the target total is the present one; else the smallest at which no domain must shrink.
    Steps go on until the targets are met or the rates rest at their bounded optimum; a fit that does neither within ``STEPS`` raises.
    """
    d = len(DOMAINS)
    if set(targets) - set(DOMAINS) or min(targets.values(), default=0) < 0 or not sum(targets.values()):
        raise ValueError("targets: nonnegative weights of known domains, not all zero")
    p, w = F.col("p"), F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = members.agg(*[F.sum(w * p[i] * p[j]) for i, j in pairs], *[F.sum(w * p[i]) for i in range(d)]).first()
    gram = np.zeros((d, d))
    for (i, j), v in zip(pairs, row[: len(pairs)], strict=True):
        gram[i, j] = gram[j, i] = v or 0.0
    present = np.array([v or 0.0 for v in row[len(pairs) :]])
    weights = np.array([targets.get(k, 0.0) for k in DOMAINS]) / sum(targets.values())
    total = present.sum()
    if not keep_total and total:
        total = max(total, max(present[k] / weights[k] for k in range(d) if weights[k] > 0.02))
    wanted = weights * total
    inverse = np.linalg.pinv(gram, rcond=1e-9)
    steps: list[tuple[list[float], float]] = []
    state, recent, still = members.select("tokens", "p", _start(floor, ceil).alias("s")), [], math.inf
    now = ahead = present * min(max(1.0, floor), ceil)
    speed, loss = 1.0, lambda x: (x - wanted) @ inverse @ (x - wanted)
    while total and still > SETTLED and np.abs(now - wanted).max() > ENOUGH * total:
        if len(steps) == STEPS:
            raise RuntimeError(f"rates did not settle in {STEPS} steps: wanted {wanted.tolist()}, reached {now.tolist()}")
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        move = ((inverse @ (ahead - wanted)).tolist(), float((speed - 1) / faster))
        speed = faster
        steps.append(move)
        recent.append(move)
        after = state.select("p", w.alias("w"), _replay(p, F.col("s"), recent, floor, ceil).alias("s"))
        sums = after.agg(*[F.sum(F.col("w") * p[k] * F.col("s")[n]) for n in ("r", "y") for k in range(d)]).first()
        last, now, ahead = now, np.array(sums[:d], float), np.array(sums[d:], float)
        if loss(now) > loss(last):  # the rates were carried too far: start again from rest
            speed = 1.0
        if len(recent) == REPLAYED:
            state, recent = stored(after.select(F.col("w").cast("long").alias("tokens"), "p", "s"), "rates"), []
            # Where no row's rate would move, the bounds hold the fit: this is the optimum.
            at_rest = _replay(p, F.struct("s.r", F.col("s.r").alias("y")), [((inverse @ (now - wanted)).tolist(), 0.0)], floor, ceil)["r"]
            still = state.agg(F.max(F.abs(at_rest - F.col("s.r")))).first()[0] or 0.0
    return Fit(steps, floor, ceil, dict(zip(DOMAINS, wanted.tolist(), strict=True)), dict(zip(DOMAINS, now.tolist(), strict=True)))


def _copies(rate: Column, doc_id: Column) -> Column:
    """Whole number of copies with the rate as its expectation: the fraction is compared with a hash of the id."""
    rate = F.round(rate, 6)
    whole = F.floor(rate)
    u = F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1_000_000)) / 1_000_000
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("long")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, most: float = MOST_REPEATS) -> DataFrame:
    """doc_id, tokens, p_<domain>, domain (the likeliest), rate, copies for every row, and wanted_<domain>, reached_<domain>: the
    target and the expected total of each domain, the same on all rows, so that a target that was missed is seen.

    Tokens are words. Null and empty texts have no tokens, the prior as posterior (as far as words speak for nothing) and a
    rate like any other. Null ids and repeated rows keep a row each; equal rows get equal rates. An empty table gives no
    rows; without labels the posterior is flat. A domain that no document can reach leaves its target unmet: rates are then
    the least-squares fit within 0 and ``most``. Ties for the likeliest domain go to the first. Other columns are ignored.
    """
    model = train(docs, labels, sample)
    members = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_in(F.col("text")).alias("tokens"), posteriors(model, F.col("text")).alias("p")), "posteriors"
    )
    fit = fit_rates(members, targets, ceil=most)
    rate = fit.rate(F.col("p"))
    names = F.array(*[F.lit(k) for k in DOMAINS])
    return members.withColumn("rate", F.round(rate, 6)).select(
        "doc_id", "tokens", *[F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(DOMAINS)],
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("domain"), "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        *[F.lit(x).alias(f"{of}_{k}") for of, totals in (("wanted", fit.wanted), ("reached", fit.reached)) for k, x in totals.items()],
    )


def remixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], floor: float = 1.0, sample: int = SAMPLE, most: float = MOST_REPEATS) -> DataFrame:
    """The documents, each as often as its rate says; with ``floor`` 1 none is lost and the mix is reached by repeats."""
    model = train(docs, labels, sample)
    p = posteriors(model, F.col("text"))
    members = stored(docs.select(words_in(F.col("text")).alias("tokens"), p.alias("p")), "posteriors")
    fit = fit_rates(members, targets, floor=floor, ceil=most, keep_total=False)
    post, copies, copy = (fresh(docs, c) for c in ("_p", "_copies", "_copy"))
    rated = docs.withColumn(post, p).withColumn(copies, _copies(fit.rate(F.col(post)), F.col("doc_id")))
    repeats = rated.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeats.select(*docs.columns)
