"""Connected components of an edge table, without gathering a component in one place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.session import checkpoint_dir

#: Alternating stars converge in a few rounds (logarithmic in the longest path); more means a bug.
MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``edges`` holds (a, b) with a < b, each once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
    moved = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
    return (
        moved.select(F.col("m").alias("a"), "b")
        .unionByName(moved.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        .distinct()
    )


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a stored table, with a count and a checksum of them. (An observed write would save a job, but leaves the
    session in a state that models cannot be serialized in.)"""
    spark = edges.sparkSession
    path = f"{checkpoint_dir(spark)}/edges-{uuid.uuid4().hex}"
    edges.write.parquet(path)
    kept = spark.read.schema(edges.schema).parquet(path)
    row = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return kept, (row[0], int(row[1] or 0))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges ``(a, b)``; the component is its smallest node.

    Large-star / small-star rounds: each is two map-side combined minima and two joins over the edge table,
    written to the shared folder, so neither a component nor its edges meet in one task or on the driver;
    the driver sees a count and a checksum per round. Empty edges give no rows; loops and repeats are fine.
    """
    edges, seen = _written(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    if not seen[0]:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    for _ in range(MAX_ROUNDS):
        edges, now = _written(_stars(edges))
        if now == seen:
            roots = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def components_of_few(edges: DataFrame, most: int) -> DataFrame | None:
    """``components`` of an edge table of at most ``most`` rows, which the driver can hold; None for a larger one."""
    rows = edges.where("a is not null and b is not null").limit(most + 1).collect()
    if len(rows) > most:
        return None
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in rows:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    kind = edges.schema["a"].dataType.simpleString()
    found = [(x, root(x)) for x in parent]
    return edges.sparkSession.createDataFrame(found, f"node {kind}, component {kind}")
