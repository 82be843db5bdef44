from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cutline.llm import bilinear as B
from tests.llm.conftest import LONG


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(n=160, seed=2):
    rng, rows = random.Random(seed), []
    follow = {w: [rng.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    for i in range(n):
        w, text = rng.choice("abcdefghij"), []
        for _ in range(rng.randrange(5, 60)):
            text.append(w if rng.random() < 0.95 else f"Rare{rng.randrange(2000)}É")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text)))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (None, "a b NULL id"), (None, None), (3, "again a b"), (4, rows[4][1]), (903, LONG)]


def check(got, rows):
    train = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, types = sum(train.values()), len(train)
    want = Counter()
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((train[x] + 1) / (total + types + 1)) for x in w)
        want[(i, held(i), len(w), sum(train[x] > 0 for x in w), total, round(base, 6))] += 1
    assert Counter((*r[:5], round(r[5], 6)) for r in got) == want
    assert all(math.isfinite(r[6]) and r[6] <= 1e-6 for r in got)


def test_counts_and_base(spark, documents):
    rows = corpus()
    got = [tuple(r) for r in B.text_scores(documents(rows, ("row", "word", "c")), 1).collect()]
    check(got, rows)


def test_rare_words_and_small_models(spark, documents, monkeypatch):
    rows = corpus()
    plain = {r["doc_id"]: r for r in B.text_scores(documents(rows[:160]), 2).collect()}
    monkeypatch.setattr(B, "HEAD", 12)  # all but twelve words go through the join
    near = [tuple(r) for r in B.text_scores(documents(rows[:160]), 2).collect()]
    check(near, rows[:160])
    assert len(plain) == 160
    assert np.mean([r["score"] > r["base_score"] for r in plain.values()]) > 0.9


def test_learns_what_follows(spark, documents):
    rows = corpus(400)[:400]
    got = [r for r in B.text_scores(documents(rows), 3).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert len(got) > 30 and gain > 0.15  # log10 a token, on texts that were not learnt from


@pytest.mark.parametrize("symbols", [1, 3, 64, 65, 200])
def test_probabilities_add_up(symbols):
    model = B.Bilinear(np.arange(symbols, 0, -1.0), seed=1)
    model.flat += np.random.default_rng(0).normal(0, 0.5, len(model.flat)).astype(np.float32)
    context = np.random.default_rng(1).integers(0, symbols + 1, (5, B.CONTEXT))
    p = np.stack([model.log_probabilities(context, np.full(5, t)) for t in range(symbols)], 1)
    assert np.allclose(np.exp(p).sum(1), 1, atol=1e-5)


def test_gradient_against_differences():
    noise = np.random.default_rng(3).integers(1, 50, 130).astype(float)
    rng = np.random.default_rng(4)
    model = B.Bilinear(noise)
    model.flat = model.flat.astype(np.float64) + rng.normal(0, 0.3, len(model.flat))
    model._views()
    context, target = rng.integers(0, 131, (40, B.CONTEXT)), rng.integers(0, 130, 40)

    def objective():
        r, total = model.foretold(context), 0.0
        for j, t in enumerate(target):
            g = t // B.WIDTH
            lo, hi = model.edges[g], model.edges[g + 1]
            for s, p, own in ((r[j] @ model.group.T, model.class_noise, g), (r[j] @ model.word[lo:hi].T, model.word_noise[lo:hi], t - lo)):
                p = p.astype(np.float64)
                odds = 1 / (1 + np.exp(p + math.log(B.NOISE) - s))
                total += math.log(odds[own]) + B.NOISE * (np.exp(p) * np.log(1 - odds)).sum()
        return total

    g = model.gradient(context, target)
    for at in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 40, replace=False):
        old = model.flat[at]
        model.flat[at] = old + 1e-5
        up = objective()
        model.flat[at] = old - 1e-5
        slope = (up - objective()) / 2e-5
        model.flat[at] = old
        assert slope == pytest.approx(g[at], rel=2e-3, abs=2e-3)


def test_empty_tables(spark, documents):
    none = documents([(1, "x")]).limit(0)
    assert B.text_scores(none).collect() == []
    out = next(i for i in range(100) if held(i))
    row = B.text_scores(documents([(out, "never seen words")])).first()  # nothing to learn from
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (4, 0, 0, 0.0, 0.0)


def test_symbols_are_sorted_by_digits_and_stay_in_order():
    symbols = np.random.default_rng(2).integers(0, B.SYMBOLS + 1, 20_000)
    assert (B._sorted(symbols) == np.argsort(symbols, kind="stable")).all()


def test_words_are_ranked_without_an_object_for_each():
    import tracemalloc

    from cutline.llm.bilinear import END, Counts, _Coder, _words

    texts = [" ".join(f"w{(7 * i + j) % 30_000}" for j in range(30_000)).encode() for i in range(2)] + [b"", b"w5 unseen w5"]
    known = tuple([END] + [f"w{i}".encode() for i in range(20_000)])
    words, coder = _words(texts), _Coder(Counts(60_006, 30_002, known, np.arange(len(known), 0, -1)))
    tracemalloc.start()
    ranks, at, distinct, ends = coder(words)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rank = {w: i for i, w in enumerate(known)}
    assert ranks.tolist() == [rank.get(w, -1) for w in words.to_pylist()]
    assert [distinct[i].as_py() for i in at[-5:].tolist()] == [END, b"w5", b"unseen", b"w5", END] and ends.tolist() == [30_000, 60_001, 60_002, 60_006]
    assert held < 2_000_000  # a list of the distinct words alone takes about that
    for empty in (_words([]), _words([b""])):
        assert _Coder(Counts(0, 0, (), np.zeros(0, np.int64)))(empty)[0].tolist() == [-1] * len(empty)
