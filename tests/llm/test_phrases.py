from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cutline.llm.phrases import Index, collocations, counted, grown
from tests.llm.conftest import LONG


def plain(rows, longest=4, least=30, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang in f:
        many = {g: c for g, c in f[lang].items() if c >= least}
        inside = defaultdict(int)
        for g, c in many.items():
            for d in range(2, len(g)):
                for i in range(len(g) - d + 1):
                    inside[g[i : i + d]] = max(inside[g[i : i + d]], c)
        found = []
        for g, a in many.items():
            if len(g) > 1 and 100 * inside.get(g, 0) < 80 * a:
                score, _, l, r = min((2000000 * a // (f[lang][g[:k]] + f[lang][g[k:]]), k, f[lang][g[:k]], f[lang][g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, g.decode(), -a, l, r, n[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed=1, docs=300, words=12):
    rng = random.Random(seed)
    vocab = ["The", "of", "É", "naïve", "a b", "x-1", "über", "the", "OF", "\x00", "café", "日本"][:words]
    rows = []
    for _ in range(docs):
        body = [rng.choice(vocab) if rng.random() < 0.7 else "New York City" for _ in range(rng.randrange(0, 60))]
        rows.append((rng.choice(["en", "de", None, ""]), "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", " ;; "]) for w in body)))
    return rows + [("en", None), ("en", ""), ("en", " .\t. "), ("en", LONG)] + [("en", "same words here again.")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(i // 2 or None, t, lang, "w1", 7) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, c long")


@pytest.mark.parametrize("size", [50, 1 << 21])
def test_against_counting(spark, size):
    rows = texts()
    got = sorted(tuple(r) for r in collocations(frame(spark, rows), size=size).collect())
    assert got == plain(rows)


def test_other_lengths_and_cuts(spark):
    rows = texts(2, 120, 5)
    for longest, least, top in ((2, 2, 5), (3, 5, 40), (4, 3, 7)):
        got = sorted(tuple(r) for r in collocations(frame(spark, rows), longest, least, top, 200).collect())
        assert got == plain(rows, longest, least, top)


def test_index_extends_both_ways():
    rng = np.random.default_rng(4)
    seq = np.r_[0, rng.integers(0, 6, 5000), 0]
    forward, backward = Index(seq, 4), Index(seq[::-1], 4)
    phrases = [np.arange(1, 6)]
    for d in (2, 3, 4):
        phrases, count = grown(forward, backward, phrases)
        want = Counter(tuple(g) for i in range(len(seq) - d + 1) if 0 not in (g := tuple(seq[i : i + d].tolist())))
        assert dict(zip(zip(*(p.tolist() for p in phrases), strict=True), count.tolist(), strict=True)) == dict(want)


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    a, b = 9_007_199_254_740_993, 18_014_398_509_481_990
    row = spark.range(1).select(F.expr(f"cast({a}L as decimal(28,0)) * cast(2000000 as decimal(10,0)) div (cast({b}L as decimal(28,0)) + cast(1L as decimal(28,0)))"))
    assert row.first()[0] == 2000000 * a // (b + 1)


def test_empty(spark):
    empty = frame(spark, [("en", "x")]).limit(0)
    assert collocations(empty).collect() == []
    assert counted(frame(spark, [(None, None)]))[1].count() == 0


def test_intervals_are_looked_at_in_runs(monkeypatch):
    import tracemalloc

    import numpy as np

    from cutline.llm import phrases as P

    seq = np.r_[0, np.random.default_rng(3).integers(0, 9, 5000), 0]
    index = P.Index(seq, 1)
    lo, hi = index.find([np.arange(1, 9)])
    whole = index.before(lo, hi)
    monkeypatch.setattr(P, "PLACES", 7)
    assert all(np.array_equal(x, y) for x, y in zip(whole, index.before(lo, hi), strict=True))
    assert [len(c) for c in index.before(lo[:0], hi[:0])] == [0] * 4
    monkeypatch.undo()
    seq = np.r_[0, np.random.default_rng(4).integers(0, 200, 1 << 20), 0]
    index = P.Index(seq, 1)
    lo, hi = index.find([np.arange(1, 200)])
    tracemalloc.start()
    index.before(lo, hi)
    assert tracemalloc.get_traced_memory()[1] < 16 * len(seq)  # spelled out at once it takes several arrays of eight bytes a place
    tracemalloc.stop()
