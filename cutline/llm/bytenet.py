"""Quality classifier: a convolutional network over the bytes of a whole text, in numpy (operator 2).

Bytes are embedded; filters of eight bytes step over the text four bytes at a time. Their outputs are
max-pooled over chunks of 512 bytes, each overlapping the next by half. The chunk values are combined, by mean and by
maximum over the document, into one logistic probability.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import bounded_batches

EMBED, STEP, FILTERS = 8, 4, 32
HALF = 256  # bytes of half a chunk
ROWS = HALF // STEP
#: Bytes looked at together; a longer text goes through in several rounds.
ROUND = 1 << 18
#: Fitting: labelled texts per class, and half chunks of one text, spread over the whole of it.
SAMPLE, SPREAD = 1500, 32
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-4
ACCEPT = 0.7


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    left: np.ndarray  # STEP * EMBED x FILTERS: the filters' first four bytes
    right: np.ndarray  # the other four
    bias: np.ndarray
    mean: np.ndarray  # weights of the mean and of the maximum over chunks
    most: np.ndarray
    shift: float

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.left, self.right, self.bias, self.mean, self.most]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _laid_out(pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in rows of STEP, each piece padded to half chunks and followed by a row of what comes after it; and how
    many half chunks each piece has."""
    halves = np.array([max(1, -(-len(p) // HALF)) for p, _ in pieces])
    laid = b"".join(p.ljust(h * HALF, b"\0") + after[:STEP].ljust(STEP, b"\0") for (p, after), h in zip(pieces, halves, strict=True))
    return np.frombuffer(laid, np.uint8).reshape(-1, STEP), halves


def _filtered(net: Net, rows: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Filter outputs: half chunk x row x filter."""
    r = net.embed[rows].reshape(len(rows), STEP * EMBED)
    out = r[:-1] @ net.left
    out += r[1:] @ net.right
    keep = np.ones(len(rows) - 1, bool)
    ends = np.cumsum(halves * ROWS + 1) - 1
    keep[ends[:-1]] = False
    return out[keep].reshape(-1, ROWS, FILTERS)


def _pooled(net: Net, pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
    rows, halves = _laid_out(pieces)
    return np.maximum(_filtered(net, rows, halves).max(1) + net.bias, 0)


def _chunks(pooled: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half chunks joined with the next of their document: values, documents, and the first halves' positions."""
    first = np.flatnonzero(of[:-1] == of[1:])
    alone = np.setdiff1d(np.arange(len(of)), np.concatenate((first, first + 1)))
    at = np.sort(np.concatenate((first, alone)))
    nxt = np.where(np.isin(at, first), at + 1, at)
    return np.maximum(pooled[at], pooled[nxt]), of[at], at


def scores(net: Net, texts: Iterable[str | None]) -> np.ndarray:
    """Probability of each text, read whole."""
    out: list[float] = []
    group: list[tuple[bytes, bytes]] = []
    of: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        pooled = _pooled(net, group)
        owner = np.repeat(np.array(of), [max(1, -(-len(p) // HALF)) for p, _ in group])
        values, docs, _ = _chunks(pooled, owner)
        starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        n = np.diff(np.concatenate((starts, [len(docs)])))[:, None]
        z = (np.add.reduceat(values, starts) / n) @ net.mean + np.maximum.reduceat(values, starts) @ net.most + net.shift
        out.extend(_sigmoid(z).tolist())
        group.clear()
        of.clear()
        size = 0

    for text in texts:
        data = encoded(text)
        if len(data) > ROUND:
            flush()
            out.append(_long(net, data))
            continue
        if size + len(data) > ROUND:
            flush()
        of.append(len(of))
        group.append((data, b""))
        size += max(len(data), HALF)
    flush()
    return np.array(out)


def _long(net: Net, data: bytes) -> float:
    total, most, n, last = np.zeros(FILTERS), np.zeros(FILTERS), 0, None
    for at in range(0, len(data), ROUND):
        pooled = _pooled(net, [(data[at : at + ROUND], data[at + ROUND : at + ROUND + STEP])])
        if last is not None:
            pooled = np.concatenate((last, pooled))
        values = np.maximum(pooled[:-1], pooled[1:])
        last = pooled[-1:]
        total += values.sum(0)
        most = np.maximum(most, values.max(0)) if len(values) else most
        n += len(values)
    return float(_sigmoid(total / max(n, 1) @ net.mean + most @ net.most + net.shift))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(p: float) -> Net:
    """A net that gives every text the same probability."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    zero = np.zeros((STEP * EMBED, FILTERS), np.float32)
    flat = np.zeros(FILTERS, np.float32)
    return Net(np.zeros((256, EMBED), np.float32), zero, zero.copy(), flat, flat.copy(), flat.copy(), float(np.log(p / (1 - p))))


def _spread(data: bytes) -> list[tuple[bytes, bytes]]:
    """Half chunks of a text for fitting: all of them, or SPREAD pairs of neighbours at even distances."""
    n = max(1, -(-len(data) // HALF))
    at = range(n) if n <= SPREAD else sorted({min(n - 1, int(i * n / (SPREAD // 2)) + j) for i in range(SPREAD // 2) for j in (0, 1)})
    return [(data[k * HALF : (k + 1) * HALF], data[(k + 1) * HALF : (k + 1) * HALF + STEP]) for k in at]


def fit(texts: list[str | None], labels: list[int], share: float | None = None, seed: int = 7) -> Net:
    """Adam on the logistic loss. ``share`` is the part of label 1 among all labelled rows; where the given texts have
    another, the bias is moved by the difference of the log odds. One class alone gives a constant."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if share is None and len(y) else share
    if not len(y) or y.min() == y.max():
        n = len(y)
        return constant((y.sum() + 1) / (n + 2) if n else 0.5)
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), *(rng.normal(0, 0.25, (STEP * EMBED, FILTERS)).astype(np.float32) for _ in range(2)),
        np.zeros(FILTERS, np.float32), *(rng.normal(0, 0.1, FILTERS).astype(np.float32) for _ in range(2)), 0.0,
    )
    laid = [_spread(encoded(t)) for t in texts]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    shift_m = [0.0, 0.0]
    step, total = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            grads, d_shift = _gradients(net, [laid[i] for i in pick], y[pick])
            step += 1
            rate = RATE * (1 - 0.95 * step / total)
            for p, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            shift_m[0] += 0.1 * (d_shift - shift_m[0])
            shift_m[1] += 0.001 * (d_shift**2 - shift_m[1])
            net.shift -= rate * (shift_m[0] / (1 - 0.9**step)) / (np.sqrt(shift_m[1] / (1 - 0.999**step)) + 1e-8)
    odds = lambda p: float(np.log(p / (1 - p)))
    net.shift = float(net.shift) + odds(min(max(share, 1e-3), 1 - 1e-3)) - odds(float(y.mean()))
    return net


def _gradients(net: Net, docs: list[list[tuple[bytes, bytes]]], y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradient of the mean loss; only the rows that won a maximum take part."""
    pieces = [p for d in docs for p in d]
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    rows, halves = _laid_out(pieces)
    raw = _filtered(net, rows, halves)
    won = raw.argmax(1)  # half x filter
    pooled = np.maximum(np.take_along_axis(raw, won[:, None, :], 1)[:, 0] + net.bias, 0)
    values, owner, at = _chunks(pooled, of)
    nxt = np.minimum(at + 1, len(of) - 1)
    second = (of[nxt] == of[at])[:, None] & (pooled[nxt] > pooled[at])
    n = np.bincount(owner, minlength=len(docs)).astype(np.float32)
    starts = np.searchsorted(owner, np.arange(len(docs)))
    mean = np.add.reduceat(values, starts) / n[:, None]
    most = np.maximum.reduceat(values, starts)
    g = (_sigmoid(mean @ net.mean + most @ net.most + net.shift) - y).astype(np.float32) / len(docs)
    d_value = (g / n)[owner][:, None] * net.mean
    top = values == most[owner]
    ties = np.add.reduceat(top, starts).astype(np.float32)
    d_value = d_value + top * (g[owner][:, None] * net.most / ties[owner])
    d_half = np.zeros_like(pooled)
    np.add.at(d_half, at, np.where(second, 0, d_value))
    np.add.at(d_half, nxt, np.where(second, d_value, 0))
    d_half *= pooled > 0
    offset = np.arange(len(of)) * (ROWS + 1)
    row = won + offset[:, None]
    d_left, d_right = np.empty_like(net.left), np.empty_like(net.right)
    d_embed = np.zeros_like(net.embed)
    embedded = net.embed[rows].reshape(len(rows), -1)
    for f in range(FILTERS):
        for k, (w, d) in enumerate(((net.left, d_left), (net.right, d_right))):
            at_f = row[:, f] + k
            d[:, f] = embedded[at_f].T @ d_half[:, f]
            back = d_half[:, f][:, None, None] * w[:, f].reshape(STEP, EMBED)
            for j in range(STEP):
                b = rows[at_f, j]
                for e in range(EMBED):
                    d_embed[:, e] += np.bincount(b, back[:, j, e], 256)
    return [d_embed, d_left, d_right, d_half.sum(0), mean.T @ g, most.T @ g], float(g.sum())


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Net:
    """Fit on at most ``sample`` texts of each class, those with the smallest hashes of their ids; the share of the
    classes is counted over all labelled rows. Rows held out, null labels and labels other than 0 and 1 are left aside."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(target).cast("int").alias("y")).where("y in (0, 1)").distinct()
    known = known.where(~held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not totals:
        return constant(0.5)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = [(r["doc_id"], r["y"]) for r in picked.collect()]  # 2 * sample at most
    small = docs.sparkSession.createDataFrame(rows, "doc_id long, y int")
    texts = docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").select("doc_id", "y", spread_text(F.col("text")).alias("t"))
    got = texts.groupBy("doc_id", "y").agg(F.min("t").alias("t")).orderBy("doc_id", "y").collect()
    return fit([r["t"] for r in got], [r["y"] for r in got], totals.get(1, 0) / sum(totals.values()))


def spread_text(text: Column) -> Column:
    """For fitting only: texts over 32,768 characters by sixteen passages of 512, at even distances, so that the sample
    stays bounded in bytes; shorter texts whole."""
    n = F.length(text)
    passages = F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring(text, (F.lit(1) + F.floor(i * n / 16)).cast("int"), F.lit(512))
    )
    return F.when(n > 32768, F.array_join(passages, "")).otherwise(F.coalesce(text, F.lit("")))


def score(net: Net, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scores(net, s), dtype="float64")

    return of(text)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    The score sees the text only. Null and empty texts are one chunk of padding and get a score like any other; texts are
    read whole, in rounds of bounded size. A null doc_id is not held out and never labelled. Repeated rows get equal
    scores. Without usable labels every score is 0.5; with one class, its smoothed share. Other columns are ignored.
    Scoring is a map over the documents: no shuffle.
    """
    bounded_batches(docs.sparkSession)
    net = train(docs, labels, sample=sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(net, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    bounded_batches(docs.sparkSession)
    net = train(docs, labels, sample=sample)
    return docs.where(score(net, F.col("text")) >= ACCEPT)
