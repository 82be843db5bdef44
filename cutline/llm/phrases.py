"""Phrase collocations by FM-indexes over word ids (operator 11).

Texts become shards of word ids, one language each. A shard is indexed forwards and backwards: the Burrows-Wheeler transform of its
words, sorted to the depth of the longest phrase. Phrases are extended by a word to the right through the backward index and to the left through
the forward one; both intervals of a phrase are kept in step, and a phrase counts if it is an extension both ways of phrases that are frequent
over all shards. Counts of the shards are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.common import bounded_batches, stored

LONGEST, LEAST, TOP, INSIDE = 4, 30, 2000, (4, 5)  # a candidate goes if a longer one has 4/5 of its count
#: Words of a shard, at least (but for the last of a task); a batch of texts or one text more at most.
SHARD = 1 << 21
#: Places of an index that are looked at together.
PLACES = 1 << 18

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")


# -- integers as compressed byte planes ------------------------------------------------------

def _packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


# -- shards ----------------------------------------------------------------------------------

def _words(texts: list[bytes]) -> pa.Array:
    """The words of texts; a line feed between pieces and after each text."""
    data = b"".join(t.translate(_TABLE).replace(b"\n", b" \n ") + b" \n " for t in texts)
    words = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten().cast(pa.large_binary())
    return words.filter(pc.not_equal(pc.binary_length(words), 0))


def _shard(parts: list[pa.Array]) -> tuple[bytes, list[bytes], list[int]]:
    """Ids (0: between pieces; else 1 + place among the words, most frequent first), the words and their counts."""
    coded = pa.concat_arrays(parts).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    n = np.bincount(ids, minlength=len(words))
    gap = words.index(pa.scalar(b"\n", pa.large_binary())).as_py()
    n[gap] = -1
    order = np.argsort(-n, kind="stable")[:-1]
    place = np.zeros(len(words), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    return _packed(place[ids]), words.take(pa.array(order)).to_pylist(), n[order].tolist()


def _shards(size: int):
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        held: dict[str, list[pa.Array]] = {}
        made = 0

        def made_of(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, words, n = _shard(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([first + made - 1]), pa.array([lang]), pa.array([ids], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([n], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for lang in dict.fromkeys(langs):
                held.setdefault(lang, []).append(_words([t for t, x in zip(texts, langs, strict=True) if x == lang and t]))
            sizes = {lang: sum(map(len, parts)) for lang, parts in held.items()}
            while sum(sizes.values()) >= size:
                most = max(sizes, key=sizes.get)
                del sizes[most]
                yield made_of(most)
        for lang in list(held):
            if sum(map(len, held[lang])):
                yield made_of(lang)

    return run


# -- index -----------------------------------------------------------------------------------

def _order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic sequence sorted by the ``depth`` symbols from there on (a power of two)."""
    key, step = seq, 1
    while step < depth:
        if step > 1:  # the place of each value among the distinct ones
            order = np.argsort(key, kind="stable")
            key = key[order]
            place = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=np.int32)
            key = np.empty(len(order), np.int32)
            key[order] = place
            del order, place
        rank, key = key, key.astype(np.int64)
        key *= int(rank.max()) + 1
        key += np.roll(rank, -step)
        step *= 2
    return np.argsort(key, kind="stable")


class Index:
    """The Burrows-Wheeler transform of a sequence over symbols from 0 (the gap) on, for patterns of up to ``depth`` symbols: sorting deeper
    would change no interval of such a pattern."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.size = len(seq) + 1
        self.bwt = seq[_order(seq, depth) - 1].astype(np.int32)
        self.start = np.r_[0, np.cumsum(np.bincount(seq))]
        self.keys = self.bwt.astype(np.int64)  # (symbol, place): ranks by bisection
        self.keys *= self.size
        self.keys += np.arange(len(seq))
        self.keys.sort()

    def extend(self, symbol: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Backward step: where the interval of ``symbol`` before the pattern starts whose own interval starts at ``lo``."""
        return np.searchsorted(self.keys, symbol * self.size + lo)

    def find(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns given as columns, the last symbol first."""
        lo, hi = self.start[patterns[0]], self.start[patterns[0] + 1]
        for symbol in patterns[1:]:
            lo, hi = self.extend(symbol, lo), self.extend(symbol, hi)
        return lo, hi

    def before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, count, symbols in the interval that are smaller) for what stands before each interval, gaps left out. Intervals
        are looked at in runs of about ``PLACES`` places, or one longer interval, so that a whole shard is never spelled out at once."""
        run = (np.cumsum(hi - lo) - 1) // PLACES
        cuts = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(lo)] if len(lo) else np.zeros(1, np.int64)
        parts = [self._before(lo[i:j], hi[i:j], i) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4

    def _before(self, lo: np.ndarray, hi: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        length = hi - lo
        of = np.repeat(np.arange(len(lo)), length)
        at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        wide = len(self.start)
        key = of * wide + self.bwt[lo[of] + at]
        key.sort()
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[cut, len(key)])
        of, symbol = np.divmod(key[cut], wide)
        smaller = cut - (np.cumsum(length) - length)[of]
        real = symbol > 0
        return of[real] + first, symbol[real], count[real], smaller[real]


def grown(forward: Index, backward: Index, phrases: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases one word longer (as columns) with their counts: those that extend one of the phrases to the right and one to the left."""
    flo, fhi = forward.find(phrases[::-1])
    rlo, rhi = backward.find(phrases)
    of, word, count, smaller = backward.before(rlo, rhi)
    starts = flo[of] + smaller
    left, symbol = forward.before(flo, fhi)[:2]
    named = np.r_[np.sort(forward.extend(symbol, flo[left])), -1]
    both = named[np.searchsorted(named[:-1], starts)] == starts
    return [c[of[both]] for c in phrases] + [word[both]], count[both]


def _pairs(key: tuple, shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Rare words become gaps; the shard's pairs of words and their counts."""
    local, word = known["place"].to_numpy() + 1, known["word"].to_numpy()
    ids = _unpacked(shard["ids"].iloc[0])
    symbol = np.zeros(int(ids.max()) + 1, np.int64)
    symbol[local] = np.arange(1, len(local) + 1)
    seq = symbol[ids]
    seq = np.r_[0, seq[(seq > 0) | (np.r_[0, seq[:-1]] > 0)], 0]
    backward = Index(seq[::-1], 1)
    one = np.arange(1, len(local) + 1)
    of, second, count, _ = backward.before(*backward.find([one]))
    return pd.DataFrame({"shard": [shard["shard"].iloc[0]], "seq": [_packed(seq)], "words": [_packed(word)], "first": [_packed(one[of])], "second": [_packed(second)], "n": [_packed(count)]})


def _keys(longest: int) -> list[str]:
    """Columns of a phrase on its way: two ids in each."""
    return [f"k{i}" for i in range((longest + 1) // 2)]


def _longer(longest: int):
    def run(key: tuple, shard: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names = _keys(longest)
        if not len(pairs) or not len(shard):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in [*names, "c"]})
        seq, words = _unpacked(shard["seq"].iloc[0]).astype(np.int32), _unpacked(shard["words"].iloc[0])
        back = np.argsort(words)
        key = pairs["key"].to_numpy()
        phrases = [back[np.searchsorted(words, w, sorter=back)] + 1 for w in (key >> 32, key & 0xFFFFFFFF)]
        depth = 1 << (longest - 1).bit_length()
        forward, backward = Index(seq, depth), Index(seq[::-1], depth)
        out = []
        for _ in range(longest - 2):
            phrases, count = grown(forward, backward, phrases)
            ids = [words[p - 1] for p in phrases] + [np.zeros(len(count), np.int64)] * (2 * len(names) - len(phrases))
            out.append(np.stack([*(a << 32 | b for a, b in zip(ids[::2], ids[1::2], strict=True)), count], 1))
        return pd.DataFrame(np.concatenate(out), columns=[*names, "c"])

    return run


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for shard, words, first, second, n in zip(*(pdf[c] for c in ("shard", "words", "first", "second", "n")), strict=True):
            w = _unpacked(words)
            yield pd.DataFrame({"shard": shard, "key": w[_unpacked(first) - 1] << 32 | w[_unpacked(second) - 1], "c": _unpacked(n)})


# -- counts over all shards ------------------------------------------------------------------

def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): words (lang, word, id, c) and phrases (w1 .. of word ids, 0 behind the last; c) of ``least`` occurrences or
    more; words of each language (lang, n). Pairs always, longer phrases up to ``longest``. Ids of frequent words must stay below 2^31.

    Texts are read once and never shuffled; compressed ids are, twice. A word or phrase is one row per shard, so that the most frequent ones weigh
    no more than others.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shards = stored(texts.mapInArrow(_shards(size), "shard long, lang string, ids binary, words array<binary>, n array<long>"), "shards")
    each = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("place", "z")).select("shard", "lang", "place", F.col("z.words").alias("word"), F.col("z.n").alias("c"))
    sums = stored(each.groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    totals = sums.groupBy("lang").agg(F.sum("c").alias("n"))
    # Small ids: the place within a written part, and the parts' sizes (one number per part on the driver).
    words = stored(sums.where(F.col("c") >= least).withColumn("m", F.monotonically_increasing_id()), "frequent")
    part = F.shiftright("m", 33)
    ends, offsets = 0, []
    for row in words.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((row["p"], ends))
        ends += row["count"]
    if ends >= 1 << 31:
        raise ValueError("more frequent words than two ids of a key can tell apart")
    start = docs.sparkSession.createDataFrame(offsets, "p long, start long")
    words = words.withColumn("p", part).join(start, "p").select("lang", "word", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1) + 1).alias("id"), "c")
    words = stored(words, "ids")
    known = each.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "place", F.col("id").alias("word"))
    index = shards.select("shard", "ids").groupBy("shard").cogroup(known.groupBy("of")).applyInPandas(
        lambda k, a, b: _pairs(k, a, b) if len(b) else pd.DataFrame({c: [] for c in ("shard", "seq", "words", "first", "second", "n")}),
        "shard long, seq binary, words binary, first binary, second binary, n binary",
    )
    index = stored(index, "index")
    pairs = index.select("shard", "words", "first", "second", "n").mapInPandas(_exploded, "shard long, key long, c int")
    # One row per shard and pair, so a window costs one shuffle and no pair is hot.
    pairs = stored(pairs.withColumn("total", F.sum("c").over(Window.partitionBy("key"))).where(F.col("total") >= least).select("shard", "key", "total"), "pairs")
    names = _keys(longest)
    phrases = pairs.groupBy("key").agg(F.first("total").alias("c")).select(F.col("key").alias("k0"), *[F.lit(0).cast("long").alias(k) for k in names[1:]], "c")
    if longest > 2:
        more = index.select("shard", "seq", "words").groupBy("shard").cogroup(pairs.select(F.col("shard").alias("of"), "key").groupBy("of")).applyInPandas(
            _longer(longest), ", ".join(f"{c} long" for c in [*names, "c"])
        )
        phrases = phrases.unionByName(more.groupBy(*names).agg(F.sum("c").alias("c")).where(F.col("c") >= least))
    halves = [h for k in names for h in (F.shiftright(k, 32), F.col(k).bitwiseAND(F.lit(0xFFFFFFFF)))]
    return words, stored(phrases.select(*[h.alias(f"w{i + 1}") for i, h in enumerate(halves[:longest])], "c"), "phrases"), totals


def _span(first: int, length: int, longest: int) -> list:
    """Key of the words from place ``first`` (1 on): as many columns as the longest phrase, 0 behind the last."""
    return [F.col(f"w{first + i}") if i < length else F.lit(0).cast("long") for i in range(longest)]


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of their weakest cut.

    Null texts count as empty, null languages as ``und``; texts without words, repeated and null ids, extra columns and empty tables need no
    care: ids are not read, and nothing found gives no rows. Ties go by count, then by the phrase's bytes.
    """
    words, phrases, totals = counted(docs, longest, least, size)
    keys = [f"k{i}" for i in range(longest)]
    key = lambda first, n: [c.alias(k) for c, k in zip(_span(first, n, longest), keys, strict=True)]
    length = reduce(lambda n, i: n + (F.col(f"w{i}") > 0).cast("int"), range(1, longest + 1), F.lit(0))
    phrases = phrases.withColumn("d", length)
    of = {d: phrases.where(F.col("d") == d) for d in range(2, longest + 1)}
    # The largest count of what is one word longer, left or right: longer ones than that cannot have more.
    wider = [of[d].select(*key(first, d - 1), "c") for d in range(3, longest + 1) for first in (1, 2)]
    left = phrases.select("*", *key(1, longest))
    if wider:
        most = reduce(DataFrame.unionByName, wider).groupBy(*keys).agg(F.max("c").alias("most"))
        left = left.join(most, keys, "left").where(F.col("most").isNull() | (INSIDE[1] * F.col("most") < INSIDE[0] * F.col("c")))
    left = stored(left.select("d", "c", *[f"w{i + 1}" for i in range(longest)]), "kept")
    counts = words.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(f"w{i}") for i in range(2, longest + 1)], "c").select(*key(1, 1), "c")
    counts = counts.unionByName(phrases.where(F.col("d") < longest).select(*key(1, longest), "c"))
    own = [f"w{i + 1}" for i in range(longest)]
    cuts = [
        left.where(F.col("d") == d).select("*", F.lit(k).alias("k"), F.struct(*key(1, k)).alias("x"), F.struct(*key(k + 1, d - k)).alias("y"))
        for d in range(2, longest + 1) for k in range(1, d)
    ]
    cuts = reduce(DataFrame.unionByName, cuts)
    counts = counts.select(F.struct(*keys).alias("key"), F.col("c").alias("f"))
    cuts = cuts.join(counts.select(F.col("key").alias("x"), F.col("f").alias("l")), "x").join(counts.select(F.col("key").alias("y"), F.col("f").alias("r")), "y")
    score = F.expr("cast(c as decimal(28,0)) * cast(2000000 as decimal(10,0)) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))")
    best = cuts.groupBy("c", *own).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    best = best.select("c", *own, "b.l", "b.r", "b.score").join(words.select(F.col("id").alias("w1"), "lang"), "w1")
    # Only what can still be among the first, ties included, is spelled out.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("c"))
    best = best.withColumn("z", F.rank().over(order)).where(F.col("z") <= top).drop("z")
    for w in own:
        best = best.join(words.select(F.col("id").alias(w), F.col("word").cast("string").alias(f"s_{w}")), w, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"s_{w}" for w in own])).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumnRenamed("c", "a").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


#: DuckDB's way to the same rows, by counting all phrases.
SQL = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, {LONGEST + 1}) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT * FROM g WHERE c >= {LEAST}),
longer AS (SELECT lang, g[s : s + d - 1] AS g, max(c) AS most FROM f, range(1, {LONGEST}) AS ss(s), range(2, {LONGEST}) AS ds(d) WHERE d < k AND s + d - 1 <= k GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, g) WHERE k > 1 AND NOT coalesce(100 * most >= 80 * c, false)),
cuts AS (SELECT lang, g, o.c AS a, j, x.c AS l, y.c AS r, ((2000000::HUGEINT * o.c) // (x.c + y.c))::BIGINT AS score FROM
  (SELECT lang, g, c, unnest(range(1, k)) AS j, k FROM kept) AS o JOIN (SELECT lang, g AS xg, c FROM f) AS x USING (lang) JOIN (SELECT lang, g AS yg, c FROM f) AS y USING (lang) WHERE xg = g[1 : j] AND yg = g[j + 1 : k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
r AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) QUALIFY rank <= {TOP}"""
