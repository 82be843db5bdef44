from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutline.operators.pit import Latest, Total, latest_at, pit_lookup, sliced_rank
from cutline.operators.skew import pick_row, salted_join

EPOCH = datetime(2020, 1, 1)


def data(spark, seed, n=300, keys=3, span=60):
    """One key holds most rows; times repeat often."""
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(keys)}"
    at = lambda: EPOCH + timedelta(hours=6 * rnd.randrange(span))
    hist = [(key(), at(), i, rnd.choice([None, 1.0, 2.5, -3.0])) for i in range(n)]
    asks = [(key(), at()) for _ in range(n // 3)]
    return (
        hist, asks, spark.createDataFrame(hist, "k string, ts timestamp, id int, v double"),
        spark.createDataFrame(asks, "k string, at timestamp"),
    )


def brute(hist, k, t, inclusive, first):
    past = [h for h in hist if h[0] == k and h[3] is not None and (h[1] <= t if inclusive else h[1] < t)]
    total = sum(h[3] for h in past) if past else None
    if not past:
        return None, total
    newest = max(h[1] for h in past)
    same = sorted((h for h in past if h[1] == newest), key=lambda h: h[2])
    return (same[0] if first else same[-1])[3], total


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("slice_days", [None, 1, 7])
def test_lookup_equals_brute_force(spark, inclusive, first, slice_days):
    hist, asks, h, a = data(spark, seed=3)
    specs = {
        "last": Latest(F.col("v"), (F.col("id"),), first, inclusive), "total": Total(F.col("v"), inclusive),
    }
    got = {(r["k"], r["at"]): (r["last"], r["total"]) for r in pit_lookup(
        [(h, "ts", specs)], a, keys=["k"], at="at", slice_days=slice_days).collect()}
    assert len(got) == len(set(asks))
    for k, t in asks:
        last, total = brute(hist, k, t, inclusive, first)
        assert got[k, t][0] == last
        assert got[k, t][1] == (None if total is None else pytest.approx(total))


def test_two_histories_share_one_lookup(spark):
    _, asks, h, a = data(spark, seed=5)
    both = pit_lookup(
        [(h, "ts", {"x": Latest(F.col("v"), (F.col("id"),))}), (h.filter("v > 0"), "ts", {"n": Total(F.lit(1))})],
        a, keys=["k"], at="at",
    )
    alone = pit_lookup([(h.filter("v > 0"), "ts", {"n": Total(F.lit(1))})], a, keys=["k"], at="at", slice_days=None)
    key = lambda r: (r["k"], r["at"])
    assert {key(r): r["n"] for r in both.collect()} == {key(r): r["n"] for r in alone.collect()}
    assert both.count() == len(set(asks))


def test_later_rows_change_nothing(spark):
    _, _, h, a = data(spark, seed=8)
    cut = F.to_timestamp(F.lit("2020-01-08"))
    early = a.filter(F.col("at") <= cut)
    specs = {"x": Latest(F.col("v"), (F.col("id"),), inclusive=True), "t": Total(F.col("v"))}
    ask = lambda hist: sorted(map(str, pit_lookup([(hist, "ts", specs)], early, keys=["k"], at="at").collect()))
    changed = h.withColumn("v", F.when(F.col("ts") > cut, F.lit(99.0)).otherwise(F.col("v")))
    assert ask(h) == ask(changed) == ask(h.filter(F.col("ts") <= cut))


@pytest.mark.parametrize("keys", [["k"], []])
def test_sliced_rank_equals_row_number(spark, keys):
    hist, _, h, _ = data(spark, seed=11)
    got = sliced_rank(
        h, keys=keys, ts="ts", order=[F.col("ts"), F.col("id")], counts={"n_pos": F.col("v") > 0}, slice_days=2
    ).collect()
    groups: dict = {}
    for r in sorted(hist, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0] if keys else 0, []).append(r)
    want = {}
    for g in groups.values():
        pos = 0
        for i, r in enumerate(g, 1):
            pos += (r[3] or 0) > 0
            want[r[2]] = (i, pos)
    assert {r["id"]: (r["rank"], r["n_pos"]) for r in got} == want


def test_latest_at_helper(table):
    h = table([("a", "2020-01-01", 1.0), ("a", "2020-01-03", 2.0)], "k string, ts timestamp, v double")
    q = table([("a", "2020-01-03"), ("a", "2019-12-31"), ("b", "2020-01-05")], "k string, at timestamp")
    inc = latest_at(h, q, keys=["k"], ts="ts", at="at", value="v")
    strict = latest_at(h, q, keys=["k"], ts="ts", at="at", value="v", inclusive=False)
    assert sorted((r["k"], r["at"].day, r["v"]) for r in inc.collect() if r["v"]) == [("a", 3, 2.0)]
    assert sorted((r["k"], r["at"].day, r["v"]) for r in strict.collect() if r["v"]) == [("a", 3, 1.0)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    big = big.unionByName(spark.range(400).select(F.lit(3).cast("long").alias("k"), (F.col("id") + 1000).alias("x")))
    small = spark.range(5).select((F.col("id") * 2).alias("k"), F.col("id").alias("y"))
    show = lambda d: sorted(map(tuple, d.select(*sorted(d.columns)).collect()), key=str)
    assert show(salted_join(big, small, ["k"], how)) == show(big.join(small, ["k"], how))


def test_pick_row_first_and_last(table):
    df = table([("a", 1, None), ("a", 2, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted(map(tuple, pick_row(df, ["k"], [F.col("o")]).collect())) == [("a", 2, "y"), ("b", 5, "z")]
    assert sorted(map(tuple, pick_row(df, ["k"], [F.col("o")], last=False).collect())) == [("a", 1, None), ("b", 5, "z")]


def test_history_is_read_and_shuffled_once(spark, tmp_path):
    """Rows inside a slice and what earlier slices carry come from one pass over the history."""
    rows = spark.range(2000).select(
        F.concat(F.lit("t"), F.col("id") % 5).alias("team"), F.timestamp_seconds(F.col("id") * 86400).alias("at"), F.col("id").cast("double").alias("x"),
    )
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            passes.add(len(pdf))
            yield pdf

    seen = rows.mapInPandas(counted, rows.schema)
    got = pit_lookup([(seen, "at", {"last": Latest(F.col("x")), "sum": Total(F.col("x"))})], rows.select("team", F.col("at").alias("cut")), keys=["team"], at="cut")
    got.write.parquet(str(tmp_path / "out"))
    assert passes.value == 2000 and spark.read.parquet(str(tmp_path / "out")).where("last is not null").count() == 1995


def test_look_up_of_the_feature_tables_is_stored_once(spark):
    """Both sides of a match read one stored block; stored snapshots are read where the missing keys are asked for."""
    from pathlib import Path

    from cutline.catalog.bindings import Views
    from cutline.catalog.features import feature_snapshots, features, v1_features

    v, folder = Views(spark, "/root/testdata/sf0.001"), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    for build in (features, v1_features):
        assert "Union" not in build(v)._jdf.queryExecution().optimizedPlan().toString().replace("InMemory", "")
    before = set(folder.glob("snapshots-*"))
    feature_snapshots(v)
    assert len(set(folder.glob("snapshots-*")) - before) == 1
