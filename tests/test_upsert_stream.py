from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from cutline.operators import ingest as I
from cutline.plans.snapshots import extend_snapshots
from cutline.plans.upsert import read_parts, upsert_parts
from cutline.streaming.keyed import append_stream

MATCH = "match_id string, kickoff_at timestamp, home_team_id string, away_team_id string, stage string"


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(folder, n), "rb") as f:
                    found[os.path.relpath(os.path.join(folder, n), path)] = hashlib.sha256(f.read()).hexdigest()
    return found


def match(i, stage, o=0):
    return (f"m{i}", "2020-01-01", "a", "b", stage, o)


def merge(stored, batch):
    return I.upsert_matches(stored, batch, ["o"])


def test_only_touched_parts_are_rewritten(spark, table, tmp_path):
    schema, path = _parse_datatype_string(MATCH), str(tmp_path / "matches")
    full = MATCH + ", o int"
    first = [match(i, "Group") for i in range(200)]
    assert upsert_parts(path, table(first, full), merge, schema, parts=16) == list(range(16))
    before = files(path)
    batch = table([match(3, "A", 1), match(3, "Final", 2), match(900, "Group")], full)
    written = upsert_parts(path, batch, merge, schema, parts=16)
    after = files(path)
    assert 1 <= len(written) <= 2
    kept = {n for n in before if int(n.split("=")[1].split("/")[0]) not in written}
    assert len(kept) == 16 - len(written) and all(after[n] == before[n] for n in kept)
    got = {r["match_id"]: r["stage"] for r in read_parts(spark, path, schema, 16).collect()}
    whole = I.upsert_matches(table(first, full).drop("o"), batch, ["o"])
    assert got == {r["match_id"]: r["stage"] for r in whole.collect()} and len(got) == 201 and got["m3"] == "Final"


def test_repeats_nulls_and_empty_batches(spark, table, tmp_path):
    schema, path, full = _parse_datatype_string(MATCH), str(tmp_path / "matches"), MATCH + ", o int"
    assert upsert_parts(path, table([], full), merge, schema, parts=4) == []
    assert read_parts(spark, path, schema, 4).count() == 0
    rows = [match(i, None) for i in range(5)]
    for _ in range(2):
        upsert_parts(path, table(rows, full), merge, schema, parts=4)
        assert read_parts(spark, path, schema, 4).count() == 5
    with pytest.raises(ValueError, match="part_of_4"):
        upsert_parts(path, table(rows, full), merge, schema, parts=8)


def test_results_in_parts(spark, table, tmp_path):
    schema = _parse_datatype_string("match_id string, home_advances boolean")
    path, full = str(tmp_path / "results"), "match_id string, home_advances boolean, o int"
    put = lambda rows: upsert_parts(path, table(rows, full), lambda t, b: I.upsert_results(t, b, ["o"]), schema, parts=8)
    put([("a", True, 0), ("b", True, 0)])
    put([("a", True, 1), ("a", False, 2), ("c", True, 1)])
    assert sorted(map(tuple, read_parts(spark, path, schema, 8).collect())) == [("a", False), ("b", True), ("c", True)]


def run(spark, parts, base, order=None):
    schema = "raw_payload_hash string, v int"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        rows = append_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), order=order)
        q = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return sorted(map(tuple, spark.read.schema(schema).parquet(f"{base}/out").collect()), key=str)


def test_stream_with_state_however_it_is_cut(spark, tmp_path):
    a, b = [("a", 1), ("b", 2), ("a", 0)], [("b", 9), ("c", 4), ("c", 3)]
    want = [("a", 0), ("b", 2), ("c", 3)]
    assert run(spark, [a, b], str(tmp_path / "two"), ["v"]) == want
    assert run(spark, [a + b], str(tmp_path / "one"), ["v"]) == want
    assert run(spark, [a, a, b], str(tmp_path / "again"), ["v"]) == want
    assert run(spark, [a, b, a], str(tmp_path / "any")) in ([("a", x), ("b", 2), ("c", y)] for x in (0, 1) for y in (3, 4))


def test_snapshots_are_built_once(table, tmp_path):
    path, schema, seen = str(tmp_path / "snapshots"), "match_id string, cutoff_time timestamp", []

    def build(spine):
        seen.append(sorted(r["match_id"] for r in spine.collect()))
        return spine.withColumns({"f": F.lit(1.5), "source_data_max_timestamp": F.col("cutoff_time")})

    def ask(rows, version="v1"):
        got = extend_snapshots(path, table(rows, schema), build, version, ["f"]).collect()
        return sorted((r["match_id"], r["immutable_hash"]) for r in got)

    assert ask([]) == [] and seen == []
    one = ask([("m1", "2020-01-01"), ("m1", "2020-01-01"), (None, "2020-01-01"), ("m9", None)])
    before = files(path)
    both = ask([("m1", "2020-01-01"), ("m2", "2020-01-02")])
    after = files(path)
    assert seen == [["m1"], ["m2"]] and one[0] in both and len(both) == 2
    assert all(after[n] == before[n] for n in before) and len(after) == len(before) + 1
    assert ask([("m2", "2020-01-02")]) == both[1:] and len(seen) == 2
    assert len(ask([("m1", "2020-01-01")], "v2")) == 1 and seen[2:] == [["m1"]]
