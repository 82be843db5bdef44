from __future__ import annotations

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from cutline.llm import simhash
from cutline.llm.near import _parities, _within, keep_one, near_rows, shingles
from tests.llm.conftest import LONG


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed, groups, copies, size):
    """Texts and copies of them with a few words changed, of similarities on both sides of 0.8; all share one passage."""
    rng = random.Random(seed)
    passage, rows = [f"common{i}" for i in range(8)], []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(4000)}" for _ in range(rng.randrange(*size))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(words + passage)))
    return rows


def expected(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if similarity(a, rows[j][1]) >= 0.8:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_components_against_all_pairs(documents):
    rows = planted(1, 12, 8, (40, 300))
    want = expected(rows)
    got = {r["doc_id"]: r["component"] for r in near_rows(documents(rows, ("g", "n", "keys", "component"))).collect()}
    assert len(set(want)) < len(rows) - 20
    for i in range(len(rows)):
        for j in range(i):
            assert (want[i] == want[j]) == (got[i + 1] == got[j + 1]), (similarity(rows[i][1], rows[j][1]), i, j)


def test_planted_near_copies_go_though_their_fingerprints_are_far_apart(documents):
    rng, rows = random.Random(7), []
    for g in range(20):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(100)]
        copy = [*base[:50], "changed", *base[51:]]  # 91 of 101 shingles
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    far = sum((simhash.fingerprint(rows[2 * g][1]) ^ simhash.fingerprint(rows[2 * g + 1][1])).bit_count() > 4 for g in range(20))
    assert far > 5
    assert sorted(r["doc_id"] for r in keep_one(documents(rows)).collect()) == [2 * g for g in range(20)]


def test_one_large_group_of_near_copies(documents):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join([*base[: 10 + i % 270], f"x{i}", *base[11 + i % 270 :]])) for i in range(400)]
    assert [r["doc_id"] for r in keep_one(documents(rows)).collect()] == [0]


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (None, LONG), (None, LONG), (7, LONG + "tail"), (8, "\U0001f600 é")]
    got = [(r["doc_id"], r["component"]) for r in near_rows(documents(rows)).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == by[3] and by[4] == by[5] != by[6] and by[8] not in (by[1], by[4], by[6])
    assert len(shingles(LONG)) == 5
    assert keep_one(documents([])).count() == 0 and near_rows(documents([]), F.col("source")).count() == 0


def test_null_and_repeated_ids_are_grouped_by_their_text(documents):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "g h i j k l"), (7, "m n o p q r"), (None, "s t u v w x"), (None, "s t u v w x")]
    assert sorted(r["text"][0] for r in keep_one(documents(rows)).collect()) == ["a", "g", "m", "s"]


def test_parities_never_rule_out_a_pair_at_the_threshold(spark):
    rng, pairs = random.Random(5), []
    for size in (1, 2, 9, 45, 180, 900, 4500):
        for _ in range(6):
            common = [rng.randrange(1 << 64) for _ in range(size)]
            own = [[rng.randrange(1 << 64) for _ in range(n)] for n in (size // 4, 0)]  # similarity 0.8 or just above
            x, y = (np.sort(np.array(common + o, np.uint64)) for o in own)
            pairs.append((_parities(x).tolist(), _parities(y).tolist(), len(x) + len(y)))
    table = spark.createDataFrame(pairs, "x array<long>, y array<long>, n long")
    assert table.where(_within(F.col("x"), F.col("y"), F.col("n"), 0.8)).count() == len(pairs)


def test_pairs_of_a_spread_group_are_ruled_out_inside_the_join(documents, spark):
    """Copies of one text from near to far: many share buckets, few pairs between different components need the whole sets."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(i % 12):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    want, folder = expected(rows), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    old = set(folder.glob("pairs-*"))
    got = {r["doc_id"]: r["component"] for r in near_rows(documents(rows)).collect()}
    pairs = sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("pairs-*")) - old)
    assert len({(w, got[i + 1]) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))
    assert pairs < 6 * len(rows)


def test_few_links_are_joined_without_rounds(documents, monkeypatch):
    from cutline.llm import near

    def never(edges):
        raise AssertionError("rounds of jobs over a handful of links")

    monkeypatch.setattr(near, "components", never)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "end"])), (2, "quite another text of a few words")]
    got = {r["doc_id"]: r["component"] for r in near_rows(documents(rows)).collect()}
    assert got[0] == got[1] != got[2]
    monkeypatch.undo()
    monkeypatch.setattr(near, "FEW", 0)
    assert {r["doc_id"]: r["component"] for r in near_rows(documents(rows)).collect()} == got


def test_stage_measures_linked_fingerprints_first(spark, documents, monkeypatch):
    import corpus_pipeline
    from cutline.llm import simhash

    seen, pairs = [], simhash.print_pairs

    def spied(rows):
        out = pairs(rows)
        seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "print_pairs", spied)
    words = [f"w{i}" for i in range(400)]
    # Two sets of one word order are one fingerprint where a repeated passage changes no majority; the third text shares the fingerprint of none.
    rows = [(0, " ".join(words)), (1, " ".join([*words, "end"])), (2, "quite another text of a few words"), (3, "Quite another text of a few words")]
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and seen == [1]


def test_whole_sets_are_not_shuffled_again_by_each_measurement(spark):
    from cutline.llm.common import bucketed
    from cutline.llm.near import _similar

    sets = spark.createDataFrame([(g, list(range(g, g + 20))) for g in range(60)], "g long, s array<long>")
    pairs = spark.createDataFrame([(g, g + d) for g in range(50) for d in (1, 3)], "a long, b long")
    dealt = bucketed(sets.repartition(3, "g"), "sets", "g", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, plain = _similar(pairs, dealt, 0.8), _similar(pairs, sets, 0.8)
        exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (got, plain)]
        assert exchanges == [2, 4]  # the pairs, and the sets that pairs name
        assert sorted(got.collect()) == sorted(plain.collect()) and got.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cutline_")]
