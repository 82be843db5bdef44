from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from cutline.llm import simhash
from cutline.llm.graph import components
from cutline.llm.simhash import fingerprint, keep_one, links, simhash_groups
from tests.llm.conftest import LONG


def plain(text, size=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(values, distance=4):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", None, "One", "One two THREE", "a b c d", "Á É a A b B c C d D", "x " * 700 + "y z"])
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


def test_fingerprint_of_a_text_in_pieces(monkeypatch):
    text = " ".join(f"word{i * i % 977}" for i in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert fingerprint(text) == whole == plain(text)


def signed(values):
    return np.array(values, np.uint64).view(np.int64).tolist()


@pytest.mark.parametrize("dense", [2048, 3])
def test_links_against_all_pairs(spark, dense):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values[:20]):
        for _ in range(6):
            values.append(v ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}))
    values = sorted(set(values))
    edges = links(spark.createDataFrame([(v,) for v in signed(values)], "f long"), dense)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = union(values)
    s = signed(values)
    for i in range(len(values)):
        for j in range(i):
            assert (want[i] == want[j]) == (got.get(s[i], s[i]) == got.get(s[j], s[j]))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == got[1000] == 1000
    assert components(edges.where("a = 7 and b = 7")).count() == 0


def test_edge_cases(documents):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, text), (1, None), (2, ""), (4, " \t\n"), (None, text), (None, "quite another text of words"), (7, LONG), (7, LONG), (6, "short")]
    got = [tuple(r) for r in simhash_groups(documents(rows, ("f", "g", "key", "component_id", "fingerprint", "first"))).collect()]
    assert len(got) == len(rows)
    by = {i: c for i, _, c in got if i is not None}
    assert by == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 4: 1, 7: 7, 6: 6}
    assert {f for i, f, _ in got if i in (1, 2, 4)} == {"0" * 16}
    assert sorted(c for i, _, c in got if i is None and c) == [3]
    assert all(f == f"{plain(t):016x}" for i, t in rows[:6] for j, f, _ in got if j == i and i)
    assert simhash_groups(documents([])).count() == 0


def test_one_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text), (7, "other words here in it"), (7, "other words here in it"), (8, None), (9, ""), (None, "loose")]
    kept = keep_one(documents(rows, ("_rows", "_row")))
    assert kept.columns == documents(rows, ("_rows", "_row")).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    assert keep_one(documents([])).count() == 0
