"""Nearest neighbours by inner product from a forest of hash prefixes (operator 1).

Each tree turns a vector into a long string of bits, the sides of random hyperplanes, and holds the vectors as an array sorted
by it. A query descends every tree to its longest matching prefix, then climbs all trees together, one bit at a time, until the
runs that share its prefix hold enough candidates; these are scored exactly.

On Spark a tree's array is dealt by a base prefix, and a run that is too long for one task by a hash of the id as well. The first
pass counts, for every query, the candidates at each depth of each tree; their sums give the depth at which the climb ends. The second
scores the runs at that depth and keeps the best of each. How many candidates are enough is measured: the least number that
reaches the wanted recall on a bounded sample of queries, whose true neighbours are found among all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cutline.llm.common import stored

TREES, BITS = 10, 60
DEEPEST = 32  # counts are kept to this depth; the runs below it are no longer told apart by the climb
TOP = 20
RECALL, SAMPLE = 0.96, 128
CHUNK, QUERIES = 1 << 16, 1 << 13  # vectors and queries of one task
BLOCK = 8192
SEED = 20


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim + 1, trees * BITS))


def _codes(x: np.ndarray, extra: np.ndarray, trees: int) -> np.ndarray:
    """Bit strings, one of each tree, as integers below 2 ** BITS."""
    side = np.hstack((x, extra[:, None])) @ _planes(x.shape[1], trees) > 0
    full = np.zeros((len(x), trees, 64), np.uint8)
    full[:, :, 64 - BITS :] = side.reshape(len(x), trees, BITS)
    return np.packbits(full, axis=-1).reshape(len(x), trees, 8).copy().view(">u8")[..., 0].astype(np.int64)


def _matrix(s: pd.Series, dim: int) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype(np.float64) if len(s) else np.empty((0, dim))


def _coded(vec: Column, dim: int, norm: float | None, trees: int) -> Column:
    """Codes of stored vectors (``norm``: the longest, so that inner products order like angles) or of queries."""

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = _matrix(s, dim)
            extra = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))
            yield pd.Series(list(_codes(x, extra, trees)))

    return of(vec)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: an id, and a vector that is finite, not zero, and of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return good.distinct()


def _dimension(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return sizes[0]["n"] if sizes else 0


def _best(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    return pdf.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of codes."""
    x = (a ^ b).astype(np.uint64)
    _, exp = np.frexp(x.astype(np.float64))  # x < 2 ** exp; rounding can only lengthen it by one bit
    exp = np.where((exp > 0) & ((x >> np.maximum(exp - 1, 0).astype(np.uint64)) == 0), exp - 1, exp)
    return BITS - exp


def enough_candidates(items: DataFrame, queries: DataFrame, k: int, trees: int) -> tuple[int, int]:
    """(candidates that reach RECALL on the sample, depth that no sampled query climbs above)."""
    probe = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).collect()
    if not probe:
        return 1, 0
    ids = np.array([r["query_id"] for r in probe])
    q = np.array([r["v"] for r in probe], float)
    qc = np.array([r["codes"] for r in probe], np.int64)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        depth = np.zeros((len(ids), DEEPEST + 1), np.int64)
        kept = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "deep": []})
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                x, c, own = _matrix(part["v"], q.shape[1]), np.vstack(part["codes"].to_numpy()), part["vec_id"].to_numpy()
                deep = np.zeros((len(ids), len(part)), np.int64)
                for t in range(trees):
                    shared = np.minimum(_shared_bits(qc[:, t][:, None], c[:, t][None, :]), DEEPEST)
                    deep = np.maximum(deep, shared)
                    for i in range(len(ids)):
                        depth[i] += np.bincount(shared[i], minlength=DEEPEST + 1)
                s = q @ x.T
                s[ids[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-s, axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), top.shape[1])
                flat = top.ravel()
                new = pd.DataFrame({"query_id": ids[rows], "vec_id": own[flat], "score": s[rows, flat], "deep": deep[rows, flat]})
                new = new[np.isfinite(new["score"])]
                kept = _best(new if kept.empty else pd.concat([kept, new]), k)
        kept["kind"] = 0
        count = pd.DataFrame({"query_id": np.repeat(ids, DEEPEST + 1), "vec_id": np.tile(np.arange(DEEPEST + 1), len(ids)), "score": depth.ravel().astype(float), "deep": 0, "kind": 1})
        yield pd.concat([kept, count]).astype({"query_id": "int64", "vec_id": "int64", "deep": "int64", "kind": "int64"})

    seen = items.select("vec_id", "v", "codes").mapInPandas(look, "query_id long, vec_id long, score double, deep long, kind long")
    seen = stored(seen, "probe")
    counts = np.zeros((len(ids), DEEPEST + 1))
    where = {i: n for n, i in enumerate(ids.tolist())}
    for r in seen.where("kind = 1").groupBy("query_id", "vec_id").agg(F.sum("score").alias("n")).collect():
        counts[where[r["query_id"]], r["vec_id"]] = r["n"]
    counts = counts[:, ::-1].cumsum(1)[:, ::-1]  # at least this deep
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = seen.where("kind = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "deep").collect()
    if not true:
        return 1, 0
    who, deep = np.array([where[r["query_id"]] for r in true]), np.array([r["deep"] for r in true])
    # The climb of query i has met a neighbour once it holds counts[i, deep] candidates.
    need = np.sort(counts[who, deep])
    enough = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))])
    end = np.array([max([0, *np.flatnonzero(c >= enough).tolist()]) for c in counts])
    return max(1, enough), int(max(0, end.min() - 1))


def _dealt(items: DataFrame, queries: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with the task they meet in: tree, base prefix, part of the vectors, part of the queries."""
    bucket = F.shiftright("code", BITS - base)
    flat = lambda df, *cols: df.select(*cols, F.posexplode("codes").alias("tree", "code")).withColumn("bucket", bucket)
    a, b = flat(items, "vec_id", "v"), flat(queries, "query_id", "v", *[c for c in queries.columns if c == "depth"])
    parts = (
        a.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
        .join(b.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / QUERIES).alias("q_parts")), ["tree", "bucket"])
    )
    parts = stored(parts, "parts")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(parts, ["tree", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("q_part", whole("q_parts"))
    right = b.join(parts, ["tree", "bucket"]).withColumn("q_part", F.pmod(F.xxhash64("query_id"), "q_parts")).withColumn("part", whole("parts"))
    return left, right


KEYS = ("tree", "bucket", "part", "q_part")


def _runs(codes: np.ndarray, q: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of the sorted codes that share the first ``depth`` bits with each query."""
    shift = (BITS - depth).astype(np.int64)
    low = (q >> shift) << shift
    return np.searchsorted(codes, low, "left"), np.searchsorted(codes, low + (np.int64(1) << shift) - 1, "right")


def _count_depths(base: int):
    def of(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        codes, q = np.sort(items["code"].to_numpy()), queries["code"].to_numpy()
        out = np.zeros((len(q), DEEPEST + 1), np.int64)
        for depth in range(base, DEEPEST + 1) if len(codes) else ():
            first, end = _runs(codes, q, np.full(len(q), depth))
            out[:, depth] = end - first
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy(), "counts": list(out)})

    return of


def _score_runs(k: int):
    def of(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(items) or not len(queries):
            return none
        items = items.sort_values(["code", "vec_id"])
        codes, ids, x = items["code"].to_numpy(), items["vec_id"].to_numpy(), np.vstack(items["v"].to_numpy())
        first, end = _runs(codes, queries["code"].to_numpy(), queries["depth"].to_numpy())
        qid, qv = queries["query_id"].to_numpy(), np.vstack(queries["v"].to_numpy())
        out = []
        order = np.lexsort((end, first))
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(first[order]) != 0) | (np.diff(end[order]) != 0)))).tolist() + [len(order)]
        for lo, hi in zip(cut, cut[1:], strict=False):  # queries with the same run together
            a, b = first[order[lo]], end[order[lo]]
            for at in range(lo, hi, 512):
                who = order[at : min(hi, at + 512)]
                for i in range(a, b, BLOCK):
                    s = qv[who] @ x[i : min(b, i + BLOCK)].T
                    s[qid[who][:, None] == ids[None, i : min(b, i + BLOCK)]] = -np.inf
                    m = min(k + 4, s.shape[1])
                    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    rows, cols = np.repeat(who, m), i + top.ravel()
                    keep = np.isfinite(s[np.repeat(np.arange(len(who)), m), top.ravel()])
                    out.append((rows[keep], cols[keep]))
        if not out:
            return none
        rows, cols = (np.concatenate(z) for z in zip(*out, strict=True))
        # Summed again row by row, so that equal vectors get equal scores wherever they were met.
        score = np.concatenate([(qv[rows[i : i + 4096]] * x[cols[i : i + 4096]]).sum(1) for i in range(0, len(rows), 4096)] or [np.empty(0)])
        return _best(pd.DataFrame({"query_id": qid[rows], "vec_id": ids[cols], "score": score}), k)

    return of


def _search(items: DataFrame, queries: DataFrame, base: int, k: int) -> DataFrame:
    left, right = _dealt(items, queries, base)
    left, right = left.select(*KEYS, "vec_id", "v", "code"), right.select(*KEYS, "query_id", "v", "code", "depth")
    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(_score_runs(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = TOP, every: int = 20, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest that the forest finds for each query (vec_id divisible by ``every``).

    Nearest first, ties to the smaller vec_id; fewer rows where there are fewer candidates. Left out: null ids; null, empty
    and zero vectors, those with a null or non-finite component or of another length than most. Rows that repeat an id and a
    vector count once; a query never meets rows of its own id. An empty table gives no rows; other columns are ignored.

    A query that does not meet enough candidates below the base prefix is searched again among all rows. Tasks hold
    ``CHUNK`` vectors and ``QUERIES`` queries at most, however many vectors share a string.
    """
    rows = usable(vectors)
    dim = _dimension(rows)
    rows = rows.where(F.size("v") == dim)
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 0.0
    items = stored(rows.select("vec_id", "v", _coded(F.col("v"), dim, norm, trees).alias("codes")), "items")
    queries = stored(
        rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", _coded(F.col("v"), dim, None, trees).alias("codes")), "queries"
    )
    enough, base = enough_candidates(items, queries, k, trees)
    left, right = _dealt(items.select("vec_id", "codes", F.lit(None).cast("array<double>").alias("v")), queries, base)
    counted = (
        left.select(*KEYS, "code").groupBy(*KEYS).cogroup(right.select(*KEYS, "query_id", "code").groupBy(*KEYS))
        .applyInPandas(_count_depths(base), "query_id long, counts array<long>")
    )
    totals = counted.groupBy("query_id").agg(*[F.sum(F.col("counts")[d]).alias(f"n{d}") for d in range(base, DEEPEST + 1)])
    depth = F.greatest(*[F.when(F.col(f"n{d}") >= enough, d).otherwise(-1) for d in range(base, DEEPEST + 1)], F.lit(0 if base == 0 else -1))
    ends = stored(totals.select("query_id", depth.cast("long").alias("depth")), "depths")
    hits = _search(items, queries.join(ends.where("depth >= 0"), "query_id"), base, k)
    if base:
        rest = queries.join(ends.where("depth >= 0"), "query_id", "left_anti").withColumn("depth", F.lit(0).cast("long"))
        one = F.slice("codes", 1, 1).alias("codes")  # one tree at its root holds every row
        hits = hits.unionByName(_search(items.select("vec_id", "v", one), rest.select("query_id", "v", one, "depth"), 0, k))
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
