"""Conflict-constrained best-fit packing (operator 5).

Documents go into bins of fixed capacity, longest first. A bin holds at most one document of a source and at most one of a
cluster of duplicates; it carries both as bitmaps. Open bins are kept in the order of what is left in them: the search starts at the
tightest bin that has room and goes on to its successors until one is compatible, so the bin found is the tightest compatible one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import stored, words_in
from cutline.llm.near import near_rows

CAPACITY = 1024
#: Documents packed together. Shards are packed apart from one another; each wastes at most its last bins.
SHARD = 8192
_SHIFT = 20  # bits of a bin's number within its shard


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items must be no longer than the capacity and come longest first."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    left: list[int] = []  # open bins by what is left: room << _SHIFT | bin
    source_map: list[int] = []
    cluster_map: list[int] = []
    out = []
    for length, s, c in zip(lengths, sources, clusters, strict=True):
        sb, cb = source_bit.get(s, 0), cluster_bit.get(c, 0)
        at, found = bisect_left(left, length << _SHIFT), -1
        while at < len(left):
            b = left[at] & ((1 << _SHIFT) - 1)
            if not (source_map[b] & sb or cluster_map[b] & cb):
                found = b
                break
            at += 1
        if found < 0:
            found, room = len(source_map), capacity
            source_map.append(0)
            cluster_map.append(0)
        else:
            room = left.pop(at) >> _SHIFT
        out.append((found, capacity - room))
        source_map[found] |= sb
        cluster_map[found] |= cb
        if room > length:
            insort(left, (room - length) << _SHIFT | found)
    return out


def _pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["tail", "cluster", "source", "doc_id", "rid"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
    shard = int(pdf["shard"].iloc[0])
    item = pdf["tail"] > 0
    some = pdf[item]
    null = lambda s: [None if pd.isna(v) else v for v in s]
    placed = best_fit(some["tail"].tolist(), null(some["source"]), null(some["cluster"]), capacity)
    nxt = 1 + max((b for b, _ in placed), default=-1)
    spot = dict(zip(some["rid"].tolist(), placed, strict=True))
    rows = []
    for rid, doc, src, cl, n, tail in zip(pdf["rid"].tolist(), pdf["doc_id"], pdf["source"], pdf["cluster"], pdf["n_tokens"].tolist(), pdf["tail"].tolist(), strict=True):
        whole = n // capacity
        for k in range(whole):
            rows.append((doc, src, cl, k, k * capacity, capacity, shard, nxt, 0))
            nxt += 1
        if tail:
            b, off = spot[rid]
            rows.append((doc, src, cl, whole, whole * capacity, tail, shard, b, off))
        elif not n:
            rows.append((doc, src, cl, 0, 0, 0, shard, None, None))
    return pd.DataFrame(rows, columns=["doc_id", "source", "cluster", "piece", "start", "n_tokens", "shard", "bin", "bin_offset"]).astype(
        {"doc_id": "Int64", "cluster": "Int64", "bin": "Int64", "bin_offset": "Int64"}
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None, cluster: Column | None = None, shard_rows: int = SHARD) -> DataFrame:
    """doc_id, source, cluster, piece, start, n_tokens, shard, bin, bin_offset: where every token of every row goes.

    ``tokens``: length of a document (words by default); ``cluster``: its duplicate cluster (hash of the exact text by
    default). A document longer than a bin is cut into full pieces, each a bin of its own, and a tail; nothing is dropped.
    Rows without tokens (null and empty texts) get a row with a null bin. A null source conflicts with nothing; equal texts,
    repeated rows among them, never share a bin. Ties are settled by cluster, source, id and row. Other columns are ignored; an
    empty table gives no rows.

    Only lengths and ids are shuffled, never texts. Shards are drawn by a hash of the row, so a source or cluster that
    holds a third of the rows is spread over all of them, and each has about ``shard_rows`` rows whatever the table's size.
    """
    tokens = words_in(F.col("text")) if tokens is None else tokens
    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text")) if cluster is None else cluster
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.cast("long").alias("cluster"),
            tokens.cast("long").alias("n_tokens"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "items",
    )
    shards = max(1, -(-rows.count() // shard_rows))
    items = rows.withColumn("tail", F.col("n_tokens") % capacity).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    schema = "doc_id long, source string, cluster long, piece long, start long, n_tokens long, shard long, bin long, bin_offset long"
    return items.groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, capacity), schema)


def packed_apart(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD) -> DataFrame:
    """``packed`` with the components of near copies (5-word shingles, similarity 0.8) as clusters, so that neither equal texts nor
    near copies share a bin. Clusters come with the rows, not by id, so that null and repeated ids have the cluster of their text."""
    rows = near_rows(docs, F.col("source").cast("string").alias("source"))
    return packed(rows, capacity, F.col("words"), F.col("component"), shard_rows)
