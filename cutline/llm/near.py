"""Near copies by exact shingle similarity: five words, Jaccard similarity of at least 0.8.

A text is the set of its 5-word shingles; equal sets are one node. Candidates share one of 32 bands of four minima; a pair of
similarity 0.8 shares none with probability (1 - 0.8^4)^32 = 5e-8, a closer pair with less. Two bits of each of the 128 minima go with a
node: pairs that differ in more than ``FAR`` of the 256 bits are left out inside the join, which a pair of similarity 0.8 does
with probability below 1e-7. A node also carries the parities of its shingles' counts in 1,024 hash classes: each shingle that only one of
two sets has flips one of them, so parities that differ in more places than the sets may differ rule a pair out for certain. Every other pair
that can still join two components is measured on the whole sets, so no pair below the threshold is linked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import bucketed, fresh, stored
from cutline.llm.graph import components, components_of_few

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 4
#: Most bits of 256 in which the minima of similar sets differ (mean 26, deviation 6 at similarity 0.8).
FAR = 60
#: Rounds in which each node is measured against one leader; what is left is measured pair by pair.
LEADERS = 4
#: Links of a round that are joined in one place; more are joined by rounds of jobs over the table.
FEW = 50_000
#: Sets that lie together, so that the pairs come to them and they are not shuffled in each round; parts of the sets at most.
TOGETHER, MOST_PARTS = 1024, 10_000
SIGN = ("s0", "s1", "s2", "s3")
#: Hash classes of shingles whose parities a node carries, and deviations above the mean that long sets' parities may differ by.
CLASSES, SIGMAS = 1024, 7.0
CHUNK = 256  # shingles that meet the hash functions at once
#: Bytes of a text that are hashed at once. Longer words are hashed one by one.
BLOCK = 1 << 16

_rng = np.random.default_rng(29)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_TIMES = _rng.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _rng.integers(1, 1 << 32, BANDS * ROWS, np.uint32)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_GAPS = b"\x20\x09\x0a\x0b\x0c\x0d"
_INSIDE = np.ones(256, bool)
_INSIDE[list(_GAPS)] = False
_BYTE[list(_GAPS)] = 0
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_BASE = int(_PLACE[0])
_POWER = np.full(BLOCK + 1, _BASE, np.uint64)
_BACK = np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
_POWER[0] = _BACK[0] = 1
_POWER, _BACK = np.multiply.accumulate(_POWER), np.multiply.accumulate(_BACK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block_words(block: bytes) -> np.ndarray:
    """Hashes of a block's words: polynomials of their bytes, summed from one start of a word to the next."""
    b = np.frombuffer(block, np.uint8)
    inside = np.zeros(len(b) + 1, bool)
    inside[1:] = _INSIDE[b]
    start = np.flatnonzero(inside[1:] > inside[:-1])
    return _mixed(np.add.reduceat(_BYTE[b] * _POWER[: len(b)], start) * _BACK[start]) if len(start) else np.zeros(0, np.uint64)


def _words(data: bytes) -> np.ndarray:
    """Hashes of a whole text's words in order; what a word's hash is depends on the word alone."""
    parts, at = [], 0
    while at < len(data):
        if len(data) - at <= BLOCK:
            end = len(data)
        elif (end := max(data.rfind(c, at, at + BLOCK + 1) for c in _GAPS)) <= at:
            word = _WORD.search(data, at)
            if word is None:
                break
            at = word.end()
            if len(word[0]) > BLOCK:
                parts.append(np.array([xxhash.xxh64_intdigest(word[0], SEED)], np.uint64))
            else:
                parts.append(_block_words(word[0]))
            continue
        parts.append(_block_words(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _text_words(text: str | None) -> np.ndarray:
    return _words((text or "").encode("utf-8", "surrogatepass").lower())


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; one for a text of fewer words, none without words."""
    return _shingled(_text_words(text), size)


def _shingled(w: np.ndarray, size: int) -> np.ndarray:
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h += w[j : len(w) - size + 1 + j] * _PLACE[j]
    h = _mixed(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _minima(s: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), CHUNK):
        low = np.minimum(low, (h[at : at + CHUNK, None] * _TIMES + _PLUS).min(0))
    return low.astype(np.uint64)


def _bands(low: np.ndarray) -> np.ndarray:
    low = low.reshape(BANDS, ROWS) * _PLACE[:ROWS]
    return _mixed(low.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _sign(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, as four integers."""
    bits = _mixed(low)[:, None] >> np.array([3, 17], np.uint64) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _parities(s: np.ndarray) -> np.ndarray:
    """Parities of a set's counts in the hash classes, as integers of 64 bits."""
    count = np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _sketches(text: Column, size: int) -> Column:
    @F.pandas_udf("g long, n long, words long, keys array<long>, odd array<long>, s0 long, s1 long, s2 long, s3 long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            ids, n, words, keys, odd, signs = [], [], [], [], [], []
            for t in s:
                w = _text_words(t)
                x = _shingled(w, size)
                low = _minima(x)
                ids.append(_set_id(x))
                n.append(len(x))
                words.append(len(w))
                odd.append(_parities(x))
                keys.append(_bands(low).view(np.int64))
                signs.append(_sign(low))
            signs = np.array(signs, np.int64).reshape(-1, len(SIGN))
            yield pd.DataFrame({"g": np.array(ids, np.uint64).view(np.int64), "n": np.array(n, np.int64), "words": np.array(words, np.int64), "keys": keys, "odd": odd} | {c: signs[:, i] for i, c in enumerate(SIGN)})

    return of(text)


def _sets(text: Column, size: int) -> Column:
    """A text's set. Declared as not deterministic: else the planner checks the join key for null, by a second call, on every text before
    the few that are wanted are picked."""

    @F.pandas_udf("g long, s array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sets = [shingles(t, size) for t in s]
            yield pd.DataFrame({"g": np.array([_set_id(x) for x in sets], np.uint64).view(np.int64), "s": [x.view(np.int64) for x in sets]})

    return of.asNondeterministic()(text)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough. ``sets`` are dealt by g: of them only those that pairs name are shuffled."""
    both = pairs.join(sets.select(F.col("g").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("g").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= F.lit(least) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def _bits(a: str, b: str) -> Column:
    """Bits in which two nodes' minima differ."""
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SIGN), F.lit(0))


def _close(a: str, b: str, least: float) -> Column:
    """Whether two nodes of different components can be similar enough."""
    size = F.least(f"{a}.n", f"{b}.n") >= F.lit(least) * F.greatest(f"{a}.n", f"{b}.n") - 1e-9
    return size & (F.col(f"{a}.c") != F.col(f"{b}.c")) & (_bits(a, b) <= FAR)


def _within(x: Column, y: Column, n: Column, least: float) -> Column:
    """Whether sets of ``n`` shingles together, with the parities x and y, can be similar enough. The parities differ in no more places than
    the sets have shingles apart; of ``far`` shingles apart, in half the classes at most and mostly in fewer."""
    apart = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(CLASSES // 64)), F.lit(0))
    far = (1 - least) / (1 + least) * n
    usual = CLASSES / 2 * (1 - F.exp(-2.0 * far / CLASSES)) + SIGMAS * F.sqrt(CLASSES / 4 * (1 - F.exp(-4.0 * far / CLASSES)))
    return apart <= F.least(far + 1e-9, usual)


def _joined(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes (g, c) after components were linked by the edges (a, b) between nodes."""
    ends = edges.join(nodes.select(F.col("g").alias("a"), F.col("c").alias("x")), "a").join(nodes.select(F.col("g").alias("b"), F.col("c").alias("y")), "b")
    ends = ends.select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components_of_few(ends, FEW)
    found = (components(ends) if found is None else found).select(F.col("node").alias("c"), "component")
    return stored(nodes.join(found, "c", "left").select("g", F.coalesce("component", "c").alias("c")), name)


def _linked(shared: DataFrame, nodes: DataFrame, odd: DataFrame, sets: DataFrame, least: float, leaders: int) -> DataFrame:
    """(g, c): the component of each of the ``nodes`` (g, c), after those that meet in buckets (key, v: node) were measured; ``odd``:
    (g, n, odd) of the buckets' nodes."""
    rows, tested = shared, None

    def labelled() -> tuple[DataFrame, DataFrame]:
        """The buckets' rows with their components, and (key, l) of the buckets of more than one component, l their leader."""
        own = rows.select("key", "v", F.col("v.g").alias("g")).join(nodes, "g").select("key", F.col("v").withField("c", F.col("c")).alias("v"))
        own = stored(own, "labelled")
        # A bucket's leader is drawn anew in each round.
        lead = own.groupBy("key").agg(F.min("v.c").alias("lo"), F.max("v.c").alias("hi"), F.min_by("v", F.xxhash64("v.g", F.lit(turn))).alias("l"))
        return own, stored(lead.where("lo < hi").select("key", "l"), "leaders")

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        nonlocal tested
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        return stored(_similar(pairs, sets, least), name)

    order = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    for turn in range(leaders):
        rows, lead = labelled()
        # Of its buckets' leaders a node is measured against the likeliest.
        near = rows.join(lead, "key").where(_close("v", "l", least))
        best = near.groupBy(F.col("v.g").alias("g")).agg(F.min_by("l.g", F.struct(_bits("v", "l").alias("d"), F.col("l.g").alias("o"))).alias("l"))
        pairs = best.select(*order("g", "l")).distinct()
        for e in ("a", "b"):
            pairs = pairs.join(odd.select(F.col("g").alias(e), F.col("n").alias(f"{e}n"), F.col("odd").alias(f"{e}o")), e)
        edges = measured(pairs.where(_within(F.col("ao"), F.col("bo"), F.col("an") + F.col("bn"), least)).select("a", "b"), "edges")
        # Components only grow: a bucket of one stays so.
        rows = rows.join(lead.select("key"), "key", "left_semi")
        if edges.isEmpty():
            break
        nodes = _joined(nodes, edges, "components")
    turn = leaders
    rows, lead = labelled()
    rows = rows.join(lead.select("key"), "key", "left_semi").withColumn("g", F.col("v.g"))
    rows = stored(rows.join(odd.select("g", "odd"), "g").select("key", F.col("v").withField("odd", F.col("odd")).alias("v")), "mixed")
    both = rows.join(rows.select("key", F.col("v").alias("w")), "key").where(
        (F.col("v.g") < F.col("w.g")) & _close("v", "w", least) & _within(F.col("v.odd"), F.col("w.odd"), F.col("v.n") + F.col("w.n"), least)
    )
    edges = measured(both.select(*order("v.g", "w.g")).distinct(), "edges")
    return nodes if edges.isEmpty() else _joined(nodes, edges, "components")


def near_rows(
    docs: DataFrame, *extra: Column, size: int = SHINGLE, least: float = SIMILAR, leaders: int = LEADERS, first: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """doc_id, g (the row's shingle set), words, component and the ``extra`` columns, one row per input row. ``component`` names a
    component of the links between sets; rows without words share one. Nothing depends on ids: null and repeated ids are
    grouped by their text like all others. Texts are read whole; only ids, hashes and the sets of candidates are shuffled.

    ``first`` gives pairs (a, b) of sets, from the rows (g, n and the ``extra`` columns), that are measured before the bands are looked at.

    Large groups stay near linear: in each of a few rounds a node is measured against one leader of its buckets, and pairs whose ends are joined
    already are dropped inside the joins. Only then are the pairs left between different components, all of them, met in their buckets and, unless
    their parities rule them out there, measured.
    """
    sketch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, _sketches(F.col("text"), size).alias("_k"))
    rows = stored(sketch.select("*", "_k.g", "_k.n", "_k.words", "_k.keys", "_k.odd", *[f"_k.{c}" for c in SIGN]).drop("_k"), "sketches")
    keys = rows.where("n > 0").select("g", F.explode("keys").alias("key"))
    # Buckets of one hold no pair. All others are found by two hashes of a row and a combined minimum; what else a node has is fetched for those only.
    many = stored(keys.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("key"), "many")
    buckets = stored(keys.join(many, "key", "left_semi").distinct(), "met")
    plain = rows.drop("n", "keys", "odd", *SIGN)
    known = stored(first(rows.where("n > 0")).select("a", "b"), "known") if first else None
    wanted = buckets.select("g")
    if known is not None:
        wanted = wanted.unionByName(known.select(F.col("a").alias("g"))).unionByName(known.select(F.col("b").alias("g")))
    members = rows.join(wanted.distinct(), "g", "left_semi").groupBy("g").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "odd", *SIGN)])
    members = stored(members, "members")
    if members.isEmpty():
        return plain.withColumn("component", F.col("g"))
    ids = stored(members.where("doc_id is not null").select("doc_id").distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    parts = min(MOST_PARTS, 1 + members.count() // TOGETHER)
    sets = texts.select(_sets(F.col("text"), size).alias("_s")).select("_s.g", "_s.s").repartition(parts, "g")
    sets = bucketed(sets.join(members.select("g").repartition(parts, "g"), "g", "left_semi").dropDuplicates(["g"]), "sets", "g", parts)
    nodes = members.select("g", F.col("g").alias("c"))
    if known is not None:
        edges = stored(_similar(known, sets, least), "edges")
        if not edges.isEmpty():
            nodes = _joined(nodes, edges, "components")
    shared = stored(buckets.join(members.select("g", F.struct("g", "n", *SIGN).alias("v")), "g").select("key", "v"), "buckets")
    found = _linked(shared, nodes, members.select("g", "n", "odd"), sets, least, leaders).select("g", F.col("c").alias("component"))
    return plain.join(found, "g", "left").withColumn("component", F.coalesce("component", "g"))


def keep_one(docs: DataFrame, *extra: Column, size: int = SHINGLE, least: float = SIMILAR, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The documents with one row of each group of near copies kept: that with the group's smallest doc_id (null ids last), then
    the smallest shingle set, then the smallest columns. ``extra`` and ``first`` go to ``near_rows``."""
    cols = docs.columns
    rows = stored(near_rows(docs, *extra, size=size, least=least, first=first), "near")
    n = fresh(docs, "_rows")
    # A group's rows are combined before the shuffle.
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "g")).alias("b")).select("b.doc_id", "b.g")
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n))
    best = stored(best.join(ids, "doc_id", "left"), "kept")
    single = stored(best.where(F.col(n) == 1).select("doc_id"), "single")
    out = docs.join(single, "doc_id", "left_semi")
    rest = best.where(F.col(n).isNull() | (F.col(n) > 1))
    if rest.isEmpty():
        return out
    g, id_, row = fresh(docs, "_g"), fresh(docs, "_id"), fresh(docs, "_row")
    again = docs.join(rest.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    again = again.withColumn(g, _sets(F.col("text"), size)["g"])
    chosen = rest.select(F.col("g").alias(g), F.col("doc_id").alias(id_))
    again = again.join(chosen, (again[g] == chosen[g]) & again["doc_id"].eqNullSafe(chosen[id_])).drop(chosen[g])
    again = again.groupBy(g).agg(F.min(F.struct(*cols)).alias(row)).select(f"{row}.*")
    return out.select(*cols).unionByName(again.select(*cols))
