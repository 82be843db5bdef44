from __future__ import annotations

from cutline.operators.components import components, components_of_few


def test_a_long_path_a_pair_and_a_loop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(121)) and got[1001] == got[1000] == 1000


def test_names_and_no_edges(spark):
    edges = spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "y")], "a string, b string")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert components(edges.where("a = 'z'")).count() == 0


def test_few_edges_without_rounds(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")], "a string, b string")
    got = {r["node"]: r["component"] for r in components_of_few(edges, 10).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert components_of_few(edges, 3) is None
    assert components_of_few(edges.limit(0), 3).count() == 0
