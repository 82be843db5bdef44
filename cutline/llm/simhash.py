"""SimHash near-duplicates, with candidates pruned by chains of fingerprint segments (operator 3).

A fingerprint of 64 bits is cut into five segments round a ring. If two fingerprints differ in at most
four bits, some segment starts a chain whose first l segments together differ in at most floor(4 l / 5)
bits, for every l: 0, 1, 2, 3, 4. So candidates come from an equi-join on (segment i equal, segment i + 1 at
most one bit apart), a key of 26 bits; the rest of the chain and the full distance are checked on the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cutline.llm.common import pieces, stored
from cutline.llm.graph import components
from cutline.llm import near

__all__ = ["fingerprint", "fingerprints", "keep_one", "links", "print_pairs", "simhash_groups"]

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (first bit, width) of the segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Buckets with more distinct fingerprints than this are linked by midpoints instead of pairs.
DENSE = 2048
PIECE = 1 << 20

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: eight bits of one weight are summed side by side."""
    rows = -(-len(h) // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[: len(h)] = h
    out = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _LANES).reshape(rows, 255).sum(1, dtype=np.uint64)
        out[:, bit] = lanes.view(np.uint8).reshape(rows, 8).sum(0, dtype=np.int64)
    return out.reshape(BITS)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, n, tail = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in pieces(data, PIECE):
        words = tail + piece
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))
            pairs = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
            h = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
            counts += _bit_counts(h)
            n += len(h)
        tail = words[max(0, len(words) - size + 1) :]
    if not n:
        if not tail:
            return 0
        n, counts = 1, _bit_counts(np.array([digest(b" ".join(tail), SEED)], np.uint64))
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in s], np.uint64).view(np.int64))

    return of(text)


def _segment(f: Column, i: int) -> Column:
    at, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(f, at).bitwiseAND(F.lit((1 << width) - 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chain_mask(i: int, length: int) -> int:
    parts = [SEGMENTS[(i + j) % len(SEGMENTS)] for j in range(length)]
    return _signed(sum(((1 << width) - 1) << at for at, width in parts))


def _keys(f: Column, i: int) -> Column:
    return F.lit(i << 26) + F.shiftleft(_segment(f, i), 13) + _segment(f, i + 1)


def _indexed(prints: DataFrame) -> DataFrame:
    keys = F.array(*[_keys(F.col("f"), i) for i in range(len(SEGMENTS))])
    return prints.select(F.col("f").alias("g"), F.explode(keys).alias("key"))


def _probes(prints: DataFrame) -> DataFrame:
    """Each fingerprint looks up its own key and, of the keys one bit apart, those with the bit cleared: of two
    fingerprints that differ there, exactly one has it set, so each pair is looked up once."""
    f, probes = F.col("f"), []
    for i in range(len(SEGMENTS)):
        base, nxt = _keys(f, i), _segment(f, i + 1)
        probes.append(F.struct(base.alias("key"), F.lit(0).alias("apart")))
        for t in range(SEGMENTS[(i + 1) % len(SEGMENTS)][1]):
            has = F.shiftright(nxt, t).bitwiseAND(F.lit(1)) == 1
            probes.append(F.when(has, F.struct((base - (1 << t)).alias("key"), F.lit(1).alias("apart"))))
    return prints.select("f", F.explode(F.filter(F.array(*probes), lambda x: x.isNotNull())).alias("p")).select(
        "f", "p.key", "p.apart"
    )


def _paired(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs that pass the whole chain and the full distance."""
    x = F.col("f").bitwiseXOR(F.col("g"))
    start = F.shiftright(F.col("key"), 26).cast("int")
    chains = [
        F.bit_count(x.bitwiseAND(F.element_at(F.array(*[F.lit(_chain_mask(i, n)).cast("long") for i in range(5)]), start + 1)))
        <= n * DISTANCE // len(SEGMENTS)
        for n in (3, 4)
    ]
    once = ((F.col("apart") == 0) & (F.col("f") < F.col("g"))) | (F.col("apart") == 1)
    return (
        probes.join(index, "key").where(once & chains[0] & chains[1] & (F.bit_count(x) <= DISTANCE))
        .select(F.col("f").alias("a"), F.col("g").alias("b"))
    )


def _starred(members: DataFrame) -> DataFrame:
    """Links inside dense buckets, linear in their size: every fingerprint names all points within two bits of it
    outside the segment that the bucket holds equal. Two that name the same point are at most four apart; two that
    are at most four apart name a common point; so linking each to the smallest that names the point loses nothing."""
    f = F.col("f")
    start = F.shiftright(F.col("key"), 26).cast("int")
    points = []
    for i, (at, width) in enumerate(SEGMENTS):
        free = [b for b in range(BITS) if not at <= b < at + width]
        masks = [0] + [_signed(1 << b) for b in free] + [_signed(1 << b | 1 << c) for k, b in enumerate(free) for c in free[k + 1 :]]
        points.append(members.where(start == i).select("key", "f", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")))
    named = points[0]
    for p in points[1:]:
        named = named.unionByName(p)
    named = named.select("key", "f", f.bitwiseXOR(F.col("m")).alias("point"))
    # A group holds distinct fingerprints within two bits of one point: 1,327 at most.
    low = F.min("f").over(W.partitionBy("key", "point"))
    return named.select(low.alias("a"), F.col("f").alias("b")).where("a <> b")


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``f`` whose components are those of all links of at most
    four bits. Buckets up to ``dense`` are joined pairwise, larger ones linked by midpoints; both are exact."""
    index, probes = _indexed(prints), _probes(prints)
    full = stored(index.groupBy("key").count().where(F.col("count") > dense).select("key"), "dense")
    if full.isEmpty():
        return _paired(probes, index)
    members = index.join(full, "key", "left_semi").select("key", F.col("g").alias("f")).unionByName(
        probes.join(full, "key", "left_semi").select("key", "f")
    ).distinct()
    return _paired(probes.join(full, "key", "left_anti"), index.join(full, "key", "left_anti")).unionByName(_starred(members))


def simhash_groups(docs: DataFrame, size: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    One row per input row; other columns are ignored, so their names cannot clash. Null and empty texts and texts
    of white space have fingerprint zero and link like any other. Rows that share a doc_id keep a row each. A null
    doc_id takes part but never names a component unless the whole component has none (then null). An empty table
    gives no rows. Texts are read whole, in pieces of bounded size; only ids and fingerprints are shuffled; copies
    collapse to one fingerprint, with a map-side combined minimum, before anything is joined.
    """
    marked = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text"), size).alias("f")), "prints")
    prints = stored(marked.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(prints.select("f"), dense))
    named = found.join(prints.withColumnRenamed("f", "node"), "node")
    low = named.groupBy("component").agg(F.min("first").alias("low"))
    named = named.select("node", "component").join(low, "component").select(F.col("node").alias("f"), "low")
    every = prints.join(named, "f", "left").select("f", F.coalesce("low", "first").alias("component_id"))
    return marked.join(every, "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def print_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets ``g`` whose fingerprints ``f`` are linked: each set and the least of its fingerprint, and the least ones of linked fingerprints."""
    sets = stored(rows.select("f", "g").distinct(), "sets-of-prints")
    prints = stored(sets.groupBy("f").agg(F.min("g").alias("least")), "prints-of-sets")
    same = sets.join(prints, "f").where("g <> least").select(F.col("least").alias("a"), F.col("g").alias("b"))
    edges = links(prints.select("f"))
    end = lambda name: prints.select(F.col("f").alias(name), F.col("least").alias(f"{name}_"))
    other = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    return same.unionByName(other).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, size: int = near.SHINGLE, least: float = near.SIMILAR) -> DataFrame:
    """``near.keep_one`` with this operator's links as the first candidates: sets whose fingerprints are at most four bits apart are measured and joined
    first; near copies with fingerprints further apart come from the bands, among what is still in different components."""
    return near.keep_one(docs, fingerprints(F.col("text")).alias("f"), size=size, least=least, first=print_pairs)
