"""Language-model scoring with a log-bilinear model (operator 12).

The next word's vector is foretold as the sum of the three words before it, each weighted by its place; a word's score is the product of that vector
with its own, plus a bias. Words are grouped in classes of equal size by frequency: a token's probability is its class's times its own within the class,
so that two small matrix products normalise it exactly. Both levels are trained in numpy by noise-contrastive estimation against
the unigram distribution, whose expectation is taken whole rather than sampled. All words beyond the model's share one symbol, divided among them by
their smoothed counts; counts cover all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import bounded_batches, fresh, stored

#: Symbols of the model at most (the rest of the words is the last one), of a class, of the context; numbers of a vector.
SYMBOLS, WIDTH, CONTEXT, SIZE = 4096, 64, 3, 16
#: Words whose counts every task knows; only rarer ones are shuffled. A bound on what is broadcast, not on what is counted.
HEAD = 65_536
#: Noise words for each token, tokens of a step, step size, and rounds: in each a part of the texts is learnt from, then models are averaged.
NOISE, BATCH, RATE, ROUNDS = 24, 16_384, 0.08, 3
PARTS = 1024  # numbers of the model that travel together
FOLDS, HELD = 7, 2

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\x09\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b" " * 5)
END = b"\n"


def _words(texts: list[bytes]) -> pa.Array:
    """Words of texts, each text ended by END."""
    data = b"".join(t.translate(_TABLE) + b" \n " for t in texts)
    words = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten().cast(pa.large_binary())
    return words.filter(pc.not_equal(pc.binary_length(words), 0))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


# -- counts ----------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0

    def flushed() -> pa.RecordBatch:
        found = pc.value_counts(pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "c"])

    for batch in batches:
        parts.append(_words(_bytes(batch)))
        size += len(parts[-1])
        if size > 1 << 21:
            yield flushed()
            parts, size = [], 0
    if size:
        yield flushed()


@dataclass(frozen=True)
class Counts:
    """What every task knows of the training texts: totals, and the most frequent words with their counts."""

    tokens: int
    types: int
    words: tuple[bytes, ...]
    counts: np.ndarray

    @property
    def modelled(self) -> int:
        return min(len(self.words), SYMBOLS - 1)

    def noise(self) -> np.ndarray:
        """Smoothed counts of the symbols; the last stands for all other words."""
        own = self.counts[: self.modelled]
        return np.r_[own + 1.0, self.tokens - own.sum() + 1.0]

    def share(self) -> float:
        """What the counts of the words that share the last symbol, plus one each and one for words never seen, add up to."""
        return float(self.tokens - self.counts[: self.modelled].sum() + self.types - self.modelled + 1)


def counted(train: DataFrame) -> tuple[DataFrame, Counts]:
    """(word, c) over all training texts, written once, and the bounded part of it that tasks keep."""
    found = train.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    table = stored(found, "words")
    row = table.agg(F.sum("c"), F.count("*")).first()
    # Words by classes of like counts, and of these the highest that are HEAD words at most together.
    level = F.floor(F.log2("c") * 16)
    floor, size = None, 0
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        size += r["count"]
        if size > HEAD:
            break
        floor = r["level"]
    head = table.where(level >= floor).collect() if floor is not None else []
    head = sorted((-r["c"], bytes(r["word"])) for r in head)
    return table, Counts(int(row[0] or 0), int(row[1]), tuple(w for _, w in head), np.array([-c for c, _ in head], np.int64))


# -- model -----------------------------------------------------------------------------------

def _log_share(s: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of the target's share of each row's softmax; ``s`` is used up."""
    s -= s.max(1, keepdims=True)
    own = s[np.arange(len(target)), target]
    return own - np.log(np.exp(s, out=s).sum(1))


def _sorted(symbols: np.ndarray) -> np.ndarray:
    """Stable order of symbols; numbers of 16 bits are sorted by their digits, several times faster."""
    return np.argsort(symbols.astype(np.uint16), kind="stable")


class Bilinear:
    """Parameters as one flat array, so that they can be sent and averaged."""

    def __init__(self, noise: np.ndarray, flat: np.ndarray | None = None, seed: int = 11):
        k = len(noise)
        self.begin, self.edges = k, np.r_[np.arange(0, k, WIDTH), k]
        n = len(self.edges) - 1
        mass = np.add.reduceat(noise, self.edges[:-1])
        self.class_noise = np.log(mass / mass.sum()).astype(np.float32)
        self.word_noise = np.log(noise / np.repeat(mass, np.diff(self.edges))).astype(np.float32)
        self.shapes = {"context": (k + 1, SIZE), "place": (CONTEXT, SIZE), "word": (k, SIZE + 1), "group": (n, SIZE + 1)}  # the last number is a bias
        if flat is None:
            rng = np.random.default_rng(seed)
            start = {"context": rng.normal(0, 0.3, (k + 1, SIZE)), "place": np.ones((CONTEXT, SIZE)) / CONTEXT,
                     "word": np.c_[rng.normal(0, 0.02, (k, SIZE)), self.word_noise], "group": np.c_[rng.normal(0, 0.02, (n, SIZE)), self.class_noise]}
            flat = np.concatenate([start[name].ravel() for name in self.shapes])
        self.flat = flat.astype(np.float32)
        self.spent = np.full(len(self.flat), 1e-2, np.float32)
        self._views()

    def _views(self) -> None:
        at = 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    def foretold(self, context: np.ndarray) -> np.ndarray:
        """The vector that is foretold for each token, and a one for the bias."""
        out = np.ones((len(context), SIZE + 1), np.float32)
        out[:, :SIZE] = sum(self.context[context[:, i]] * self.place[i] for i in range(CONTEXT))
        return out

    def _classes(self, group: np.ndarray):
        """(rows, first symbol, end) of each class that occurs; rows are sorted by class."""
        cuts = np.searchsorted(group, np.arange(len(self.edges)))
        return [(slice(cuts[c], cuts[c + 1]), self.edges[c], self.edges[c + 1]) for c in np.flatnonzero(np.diff(cuts))]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all symbols."""
        order = _sorted(target)
        context, target = context[order], target[order]
        r, group = self.foretold(context), target // WIDTH
        found = _log_share(r @ np.ascontiguousarray(self.group.T), group).astype(np.float64)
        columns = np.ascontiguousarray(self.word.T)
        for rows, lo, hi in self._classes(group):
            found[rows] += _log_share(r[rows] @ columns[:, lo:hi], target[rows] - lo)
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def _contrast(s: np.ndarray, noise: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradient of the noise-contrastive objective by the scores, the noise's expectation whole. ``s`` is used up."""
        np.subtract(noise + np.float32(np.log(NOISE)), s, out=s)
        np.exp(np.minimum(s, 60, out=s), out=s)
        s += 1
        odds = np.reciprocal(s, out=s)  # that the word is text and not noise
        rows = np.arange(len(target))
        own = 1 - odds[rows, target]
        odds *= -NOISE * np.exp(noise)
        odds[rows, target] += own
        return odds

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Ascent direction of a batch, flat."""
        out = Bilinear.__new__(Bilinear)
        out.shapes, out.flat = self.shapes, np.zeros_like(self.flat)
        out._views()
        order = _sorted(target)
        context, target = context[order], target[order]
        r, group = self.foretold(context), target // WIDTH
        g = self._contrast(r @ np.ascontiguousarray(self.group.T), self.class_noise, group)
        out.group[:] = g.T @ r
        back = g @ np.ascontiguousarray(self.group[:, :SIZE])
        columns, vectors = np.ascontiguousarray(self.word.T), np.ascontiguousarray(self.word[:, :SIZE])
        for rows, lo, hi in self._classes(group):
            g = self._contrast(r[rows] @ columns[:, lo:hi], self.word_noise[lo:hi], target[rows] - lo)
            out.word[lo:hi] = g.T @ r[rows]
            back[rows] += g @ vectors[lo:hi]
        for i in range(CONTEXT):
            word = context[:, i]
            out.place[i] = (back * self.context[word]).sum(0)
            order = _sorted(word)
            word = word[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out.context[word[first]] += np.add.reduceat((back * self.place[i])[order], first, axis=0)
        return out.flat

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step with a rate for each parameter by what it has moved before."""
        g = self.gradient(context, target) / np.float32(len(target))
        g *= np.float32(1 << 10)
        self.spent += g * g
        self.flat += np.float32(RATE) * g / np.sqrt(self.spent)


def _contexts(symbols: np.ndarray, ends: np.ndarray, begin: int) -> np.ndarray:
    """The symbols before each token within its text, nearest first; ``begin`` before the text."""
    out = np.full((len(symbols), CONTEXT), begin, np.int64)
    start = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    depth = np.arange(len(symbols)) - np.repeat(start, ends - start + 1)
    for i in range(CONTEXT):
        deep = np.flatnonzero(depth > i)
        out[deep, i] = symbols[deep - i - 1]
    return out


class _Coder:
    """Ranks of words among the frequent ones; -1 for the rest."""

    def __init__(self, counts: Counts):
        self.words = pa.array(counts.words, pa.large_binary())

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(rank of each token, place of each among the distinct words, these, place of each text's end)."""
        coded = words.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1)  # in Arrow: a batch has tens of thousands of distinct words
        ranks, at = found.to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy()
        end = pc.index(coded.dictionary, pa.scalar(END, pa.large_binary())).as_py()
        return ranks[at], at, coded.dictionary, np.flatnonzero(at == end)


def _train(counts, flat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        coder, model = _Coder(known), Bilinear(known.noise(), flat.value)
        tail, seen = known.modelled, 0
        for batch in batches:
            ranks, _, _, ends = coder(_words(_bytes(batch)))
            symbols = np.where((ranks >= 0) & (ranks < tail), ranks, tail)
            context = _contexts(symbols, ends, model.begin)
            order = np.random.default_rng(seen).permutation(len(symbols))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                model.learn(context[rows], symbols[rows])
            seen += len(symbols)
        if seen:
            n = -(-len(model.flat) // PARTS)
            parts = np.zeros(n * PARTS)
            parts[: len(model.flat)] = model.flat
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(parts.reshape(n, PARTS))), pa.array([float(seen)] * n)], names=["part", "v", "n"])

    return run


def fitted(train: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """Flat parameters. Each round every task learns from its share of a part of the texts, starting from the same model; the models are averaged by
    tokens on the executors. Every training text is learnt from once, and the driver sees one model a round."""
    sc = train.sparkSession.sparkContext
    model = Bilinear(counts.noise())
    known = sc.broadcast(counts)
    for turn in range(rounds):
        start = sc.broadcast(model.flat)
        part = train.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).select("text")
        found = part.mapInArrow(_train(known, start), "part int, v array<double>, n double")
        mean = found.groupBy("part").agg(Summarizer.mean(array_to_vector("v"), F.col("n")).alias("v"))
        rows = sorted((r["part"], r["v"]) for r in mean.select("part", vector_to_array("v").alias("v")).collect())
        if rows:
            model = Bilinear(counts.noise(), np.concatenate([v for _, v in rows])[: len(model.flat)])
    return model.flat


# -- scores ----------------------------------------------------------------------------------

_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, n: long>>"


def _score(counts, flat):
    rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        coder, model = _Coder(known), Bilinear(known.noise(), flat.value)
        tail = known.modelled
        smoothed = np.log10((np.r_[known.counts, 0] + 1.0) / (known.tokens + known.types + 1.0))
        within = np.r_[np.zeros(tail), np.log10((known.counts[tail:] + 1.0) / known.share()), 0.0]
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks, at, words, ends = coder(_words(_bytes(batch)))
            symbols = np.where((ranks >= 0) & (ranks < tail), ranks, tail)
            context = _contexts(symbols, ends, model.begin)
            score = np.concatenate([model.log_probabilities(context[i : i + BATCH], symbols[i : i + BATCH]) for i in range(0, len(symbols), BATCH)]) / np.log(10)
            score += within[ranks]  # words beyond the frequent ones get theirs from their counts
            base, found = np.where(ranks >= 0, smoothed[ranks], 0.0), ranks >= 0
            start = np.r_[0, ends[:-1] + 1]
            text = np.repeat(np.arange(len(ends)), ends - start + 1)
            far = np.flatnonzero(~found)
            key, n = np.unique(text[far] * max(1, len(words)) + at[far], return_counts=True)
            of, word = np.divmod(key, max(1, len(words)))
            pairs = pa.StructArray.from_arrays([words.take(pa.array(word)).cast(pa.binary()), pa.array(n)], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(ends) + 1)), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(ends - start + 1), pa.array(np.add.reduceat(found.astype(np.int64), start)),
                pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(score, start)), lists.cast(rare),
            ], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def text_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row, scores in log10 of whole texts.

    Null texts count as empty (one token, the end); a null doc_id is not held out and is learnt from; repeated rows get equal scores; other columns
    are ignored; an empty table gives no rows. Where nothing can be learnt from, every token has probability one.

    Texts are never shuffled. Counting shuffles a row per task and word, scoring a row per text and rare word (not among the
    65,536 most frequent ones at most, whose counts all tasks hold).
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where(~F.col("held_out"))
    table, counts = counted(train)
    flat = fitted(train, counts, rounds)
    row = fresh(rows, "row")
    scored = rows.withColumn(row, F.monotonically_increasing_id()).mapInArrow(_score(sc.broadcast(counts), sc.broadcast(flat)), _SCORED)
    scored = stored(scored, "scored")
    pairs = scored.select("row", F.explode("rare").alias("z")).select("row", "z.word", F.col("z.n").alias("n"))
    if counts.words:
        table = table.where(F.col("c") < int(counts.counts[-1]))
    c = F.coalesce("c", F.lit(0))
    more = pairs.join(table, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(counts.tokens + counts.types + 1)))).alias("more_base"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(counts.share()))).alias("more"),
    )
    out = scored.drop("rare").join(more, "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more")).alias("score"),
    )
