from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from cutline.llm import packing, tokenpack
from cutline.llm.packing import best_fit, packed, packed_apart
from cutline.llm.tokenpack import best_fit_decreasing, encode, encoder, positions, segment_digests, write_packed
from cutline.llm.common import shared_path
from tests.llm.conftest import LONG


def slow_best_fit(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        ok = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and b["left"] and s not in b["s"] and c not in b["c"]]
        if ok:
            i = min(ok)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["s"] |= {s} - {None}
        bins[i]["c"] |= {c} - {None}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_tightest_compatible_bin_is_found(seed):
    rng = random.Random(seed)
    n = 400
    lengths = sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True)
    sources = [rng.choice(["hot"] * 3 + [None, "a", "b", "c", "d"]) for _ in range(n)]
    clusters = [rng.choice([None, 1, 1, *range(200)]) for _ in range(n)]
    assert best_fit(lengths, sources, clusters, 64) == slow_best_fit(lengths, sources, clusters, 64)


def words(n, k=0):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_packed(documents, monkeypatch):
    rng = random.Random(2)
    same = words(20)
    rows = [(i, words(rng.randrange(0, 80), i), f"s{rng.randrange(4) if rng.random() < 0.6 else 9}") for i in range(150)]
    rows += [(500 + i, same, f"t{i}") for i in range(50)] + [(7, rows[7][1], "s9"), (None, words(5, 3), None), (901, None), (902, ""), (903, " \n"), (904, words(500, 4), "s1")]
    got = packed(documents(rows, ("rid", "shard", "tail", "cluster")), capacity=64, shard_rows=60).collect()
    keyed = {}
    for r in got:
        if r["bin"] is None:
            assert r["n_tokens"] == 0
            continue
        keyed.setdefault((r["shard"], r["bin"]), []).append(r)
    for b in keyed.values():
        b.sort(key=lambda r: r["bin_offset"])
        assert sum(r["n_tokens"] for r in b) <= 64
        assert [r["bin_offset"] for r in b] == np.cumsum([0] + [r["n_tokens"] for r in b])[:-1].tolist()
        s = [r["source"] for r in b if r["source"] is not None]
        c = [r["cluster"] for r in b if r["cluster"] is not None]
        assert len(set(s)) == len(s) and len(set(c)) == len(c)
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert total == want
    long = sorted((r["start"], r["n_tokens"]) for r in got if r["doc_id"] == 904)
    assert [s for s, _ in long] == list(range(0, 500, 64)) and sum(n for _, n in long) == 500
    assert packed(documents([])).count() == 0
    assert packing.CAPACITY > 0


def test_near_copies_never_share_a_bin(documents):
    texts = [words(60, k) for k in range(10)]
    rows = [(i if i % 7 else None, f"{texts[i % 10]} tail{i // 10}", f"s{i}") for i in range(50)]
    got = packed_apart(documents(rows, ("component", "g", "n_tokens")), capacity=640).collect()
    assert len(got) == len(rows) and sum(r["n_tokens"] for r in got) == 61 * len(rows)
    assert len({r["cluster"] for r in got}) == 10
    bins = {}
    for r in got:
        bins.setdefault((r["shard"], r["bin"]), []).append(r["cluster"])
    assert len(bins) == 5 and all(len(set(b)) == len(b) for b in bins.values())


@pytest.mark.parametrize("seed", range(4))
def test_segment_tree_search(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(300)]
    left, want = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [room for room, _ in left if room >= lengths[i]]
        if fits:
            j = next(j for j, (room, _) in enumerate(left) if room == min(fits))
            room, row = left.pop(j)
        else:
            room, row = capacity, len({r for r, _ in filter(None, want)})
        want[i] = (row, capacity - room)
        if room > lengths[i]:
            left.append((room - lengths[i], row))
    assert best_fit_decreasing(lengths, capacity) == want


def test_token_matrices(spark, documents, monkeypatch):
    rng = random.Random(4)
    rows = [(i, words(rng.randrange(0, 60), i)) for i in range(80)] + [(3, words(30, 3)), (None, "no id"), (90, None), (91, ""), (92, LONG), (93, "é\U0001d11e <|endoftext|> \t")]
    docs = documents(rows, ("matrix", "ids", "row"))
    m = write_packed(docs, shared_path(spark, "tok"), width=128, block=(50, 5000))
    with open(tokenpack.VOCABULARY, "rb") as f:
        enc = encoder(f.read())
    pieces = {}
    for r in m.collect():
        ids = np.frombuffer(r["ids"], "<u2").reshape(r["n_rows"], 128)
        for s in r["segments"]:
            part = ids[s["row"], s["row_offset"] : s["row_offset"] + s["n_tokens"]].tolist() if s["row"] is not None else []
            pieces.setdefault(s["doc_id"], []).append((s["start"], part))
        for row in range(r["n_rows"]):
            cuts = r["cu_seqlens"][row]
            assert cuts[0] == 0 and cuts == sorted(cuts) and (ids[row, cuts[-1] :] == tokenpack.END).all()
            p = positions(cuts, 128)
            assert np.flatnonzero(p == 0).tolist() == r["resets"][row]
            assert sorted(s["row_offset"] for s in r["segments"] if s["row"] == row) == cuts[:-1]
    for i, t in rows:
        if i in (3, 7):
            continue
        ids = [x for _, part in sorted(pieces[i]) for x in part]
        assert ids == (enc.encode_ordinary(t) + [tokenpack.END] if t else [])
        assert enc.decode(ids[:-1]) == (t or "")
    assert sum(s == 0 for s, _ in pieces[3]) == 2
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in segment_digests(m).collect() if r["doc_id"] != 3}
    assert all(c == (zlib.crc32(np.array(dict(pieces[i])[s], "<u2").tobytes()) if dict(pieces[i])[s] else 0) for (i, s), c in crc.items())
    assert write_packed(documents([]), shared_path(spark, "tok")).count() == 0


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    with open(tokenpack.VOCABULARY, "rb") as f:
        enc = encoder(f.read())
    text = "some  words, here's 12 more\n\nof it é ü   x " * 50
    whole = enc.encode_ordinary(text)
    for size in (1, 7, 40):
        monkeypatch.setattr(tokenpack, "PART", size)
        assert encode(enc, text).tolist() == whole
