"""Exact top-k search by BM25 over an inverted index, with block-max WAND (operator 9).

The index is a table: a shard is a block of documents, and its terms lie in buckets by hash. A bucket holds for
each term its postings (document, count) in blocks of 128 with the largest count and the shortest document of the block, from
which an upper bound of any score in it follows once the global statistics are known. A search finds the query terms' postings,
adds up document frequencies over the shards, runs WAND with block bounds in every shard and merges the shards' best.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cutline.llm.common import shared_path, stored

K1, B = 1.2, 0.75
TOP = 10
BLOCK = 128
#: Documents (and words) of a shard, buckets of terms, queries of a search task.
SHARD_DOCS, SHARD_WORDS, BUCKETS, QUERIES = 4096, 1 << 22, 4096, 256
_WORD = re.compile(r"[^\W_]+")

INDEX = "shard string, bucket int, n_docs long, n_words long, terms binary, ends binary, docs binary, counts binary"
_ARROW = pa.schema([
    ("shard", pa.string()), ("bucket", pa.int32()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("terms", pa.binary()), ("ends", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()),
])


def terms_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def bucket_of(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) % BUCKETS


def _shard_rows(shard: str, ids: list, lengths: list[int], vocabulary: dict[str, int], pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
    """Bucket -1 has the documents' ids and lengths (null ids as the least long); the others the postings of their terms."""
    known = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
    yield {
        "shard": shard, "bucket": -1, "n_docs": len(ids), "n_words": int(sum(lengths)), "terms": b"", "ends": b"", "docs": known.tobytes(),
        "counts": np.array(lengths, np.int64).tobytes(),
    }
    if not vocabulary:
        return
    names = list(vocabulary)
    term = np.concatenate([t for t, _ in pairs])
    doc = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(t) for t, _ in pairs])
    count = np.concatenate([c for _, c in pairs])
    by_name = np.array(sorted(range(len(names)), key=lambda i: (bucket_of(names[i]), names[i])), np.int64)
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    order = np.lexsort((doc, rank[term]))
    doc, count = doc[order], count[order].astype(np.int32)
    ends = np.cumsum(np.bincount(rank[term], minlength=len(names)))
    buckets = np.array([bucket_of(names[i]) for i in by_name.tolist()])
    cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))).tolist() + [len(names)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        first, last = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
        yield {
            "shard": shard, "bucket": int(buckets[a]), "n_docs": 0, "n_words": 0, "terms": "\n".join(names[i] for i in by_name[a:b].tolist()).encode("utf-8", "surrogatepass"),
            "ends": (ends[a:b] - first).astype(np.int32).tobytes(), "docs": doc[first:last].tobytes(), "counts": count[first:last].tobytes(),
        }


def build_index(docs: DataFrame, folder: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Index every row of ``docs`` (doc_id, text) where it is read: no shuffle. Shards are bounded in documents and words;
    a text of any length is one document."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, vocabulary, pairs, words = [], [], {}, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                counted = Counter(found)
                numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in counted]
                pairs.append((np.array(numbers, np.int32), np.fromiter(counted.values(), np.int32, len(counted))))
                ids.append(doc)
                lengths.append(len(found))
                words += len(found)
                if len(ids) >= shard_docs or words >= SHARD_WORDS:
                    yield from _batches(_shard_rows(f"{part:06d}-{number:06d}", ids, lengths, vocabulary, pairs))
                    number += 1
                    ids, lengths, vocabulary, pairs, words = [], [], {}, [], 0
        if ids:
            yield from _batches(_shard_rows(f"{part:06d}-{number:06d}", ids, lengths, vocabulary, pairs))

    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX).write.parquet(folder)
    return docs.sparkSession.read.schema(INDEX).parquet(folder)


def _batches(rows: Iterator[dict], size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times, bucket: a row per distinct term of each query."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, t, n, bucket_of(t)) for q, text in zip(pdf["query_id"], pdf["text"], strict=True) for t, n in Counter(terms_of(text)).items()]
            yield pd.DataFrame(rows, columns=["query_id", "term", "times", "bucket"])

    return queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text").mapInPandas(split, "query_id long, term string, times long, bucket int")


def _postings(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """shard, term, df, docs, counts of the wanted terms (term, bucket)."""
    by_bucket = wanted.select("bucket", "term").distinct().groupBy("bucket").agg(F.collect_set("term").alias("wanted"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                names = {t: i for i, t in enumerate(r["terms"].decode("utf-8", "surrogatepass").split("\n"))}
                ends = np.frombuffer(r["ends"], np.int32)
                for t in r["wanted"]:
                    i = names.get(t)
                    if i is not None:
                        a, b = 4 * (int(ends[i - 1]) if i else 0), 4 * int(ends[i])
                        rows.append({"shard": r["shard"], "term": t, "df": (b - a) // 4, "docs": r["docs"][a:b], "counts": r["counts"][a:b]})
            yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
    # Buckets are 4,096 at most, so this list is bounded; it is pushed into the scan.
    ids = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    rows = index.where(F.col("bucket").isin(ids)).join(by_bucket, "bucket").select("shard", "terms", "ends", "docs", "counts", "wanted")
    return rows.mapInArrow(pick, "shard string, term string, df long, docs binary, counts binary")


class _List:
    """A term's postings in a shard, with block bounds and a cursor."""

    __slots__ = ("docs", "counts", "weight", "at", "doc", "lasts", "bounds", "top")

    def __init__(self, docs: np.ndarray, counts: np.ndarray, weight: float, lengths: np.ndarray, mean: float) -> None:
        self.docs, self.counts, self.weight = docs.tolist(), counts.tolist(), weight
        starts = np.arange(0, len(docs), BLOCK)
        most = np.maximum.reduceat(counts, starts).astype(float)
        short = np.minimum.reduceat(lengths[docs], starts)
        bound = weight * most * (K1 + 1) / (most + K1 * (1 - B + B * short / mean))
        self.lasts = [self.docs[min(s + BLOCK, len(docs)) - 1] for s in starts.tolist()]
        self.bounds = (bound * (1 + 1e-9)).tolist()
        self.top = max(self.bounds)
        self.at, self.doc = 0, self.docs[0]

    def to(self, doc: int, end: int) -> None:
        self.at = bisect_left(self.docs, doc, self.at)
        self.doc = self.docs[self.at] if self.at < len(self.docs) else end


def block_max_wand(lists: list[_List], lengths: list[int], ids: list[int], mean: float, k: int) -> list[tuple[float, int, int]]:
    """The k best (score, id, document) of a shard. Bounds are kept a hair high and only what lies strictly below the
    k-th best is passed over, so ties are met and go to the smaller id."""
    end = len(lengths)
    heap: list[tuple[float, int, int]] = []  # (score, -id, -document): the worst on top
    least = -1.0
    live = list(lists)
    while live:
        live.sort(key=lambda x: x.doc)
        total, pivot = 0.0, -1
        for i, x in enumerate(live):
            total += x.top
            if total >= least:
                pivot = i
                break
        if pivot < 0:
            break
        doc = live[pivot].doc
        while pivot + 1 < len(live) and live[pivot + 1].doc == doc:
            pivot += 1
        bound, upto = 0.0, end
        for x in live[: pivot + 1]:
            b = bisect_left(x.lasts, doc)
            if b < len(x.lasts):
                bound += x.bounds[b]
                upto = min(upto, x.lasts[b] + 1)
        if bound >= least:
            if live[0].doc == doc:
                norm = K1 * (1 - B + B * lengths[doc] / mean)
                score = 0.0
                for x in lists:
                    if x.doc == doc:
                        c = x.counts[x.at]
                        score += x.weight * c * (K1 + 1) / (c + norm)
                entry = (score, -ids[doc], -doc)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == k:
                    least = heap[0][0]
                for x in live[: pivot + 1]:
                    x.to(doc + 1, end)
            else:
                for x in live[: pivot + 1]:
                    if x.doc < doc:
                        x.to(doc, end)
        else:
            nxt = max(doc + 1, min(upto, live[pivot + 1].doc if pivot + 1 < len(live) else end))
            for x in live[: pivot + 1]:
                x.to(nxt, end)
        live = [x for x in live if x.doc < end]
    return sorted(((s, -i, -d) for s, i, d in heap), key=lambda x: (-x[0], x[1], x[2]))


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each query (query_id, text) by exact BM25.

    Documents without a term of the query have no score and are not returned. Ties go to the smaller doc_id; rows that
    repeat a doc_id are documents of their own. Null and empty texts match nothing but count as documents. Queries with a null
    id, or without words, give no rows, and so does an empty table; queries that repeat an id are not told apart.
    """
    index_docs = index.where("bucket = -1")
    n, words = index_docs.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    mean = max(words / n, 1e-9) if n else 1.0
    terms = stored(query_terms(queries), "query-terms")
    found = stored(_postings(index, terms), "postings")
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = found.groupBy("term").agg(F.sum("df").alias("df")).select("term", idf.alias("idf"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-terms.select("query_id").distinct().count() // QUERIES)))).cast("int")
    asked = terms.join(weights, "term").select(block.alias("block"), "query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    asked = stored(asked, "weights")
    # Every shard with a posting meets every block of queries once: the stated set against all rows, in blocks.
    parts = found.join(asked.select("term", "block").distinct(), "term").select("shard", "block", F.lit(0).alias("kind"), "term", "docs", "counts")
    whole = index_docs.select("shard", "docs", "counts")
    pairs = parts.select("shard", "block").distinct()
    left = parts.unionByName(whole.join(pairs, "shard").select("shard", "block", F.lit(1).alias("kind"), F.lit("").alias("term"), "docs", "counts"))
    right = pairs.join(asked, "block").select(F.col("shard").alias("shard"), F.col("block").alias("block"), "query_id", "term", "weight")

    def run(shard: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        own = shard[shard["kind"] == 1]
        if len(own) and len(ask):
            ids = np.frombuffer(own["docs"].iloc[0], np.int64).tolist()
            lengths = np.frombuffer(own["counts"].iloc[0], np.int64)
            held = {t: (np.frombuffer(d, np.int32), np.frombuffer(c, np.int32)) for t, d, c in shard.loc[shard["kind"] == 0, ["term", "docs", "counts"]].itertuples(index=False)}
            for q, group in ask.groupby("query_id"):
                terms = sorted((t, w) for t, w in zip(group["term"], group["weight"], strict=True) if t in held)
                lists = [_List(*held[t], w, lengths, mean) for t, w in terms]
                rows += [(q, i, s, d) for s, i, d in block_max_wand(lists, lengths.tolist(), ids, mean, k)]
        return pd.DataFrame(rows, columns=["query_id", "doc_id", "score", "at"])

    keys = ("shard", "block")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, doc_id long, score double, at long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "at")
    least = F.lit(-(1 << 63)).cast("long")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "score"
    )


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, every: int = 20) -> DataFrame:
    """Benchmark items whose id is divisible by ``every``, searched in all documents."""
    index = build_index(docs, shared_path(docs.sparkSession, "bm25"))
    return search(index, items.where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), "text"), k)
