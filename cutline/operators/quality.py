"""Data-quality gate: one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.operators.labels import unmatched_shootouts
from cutline.operators.manifest import duplicate_keys


def check_row(df: DataFrame, name: str, bad: Column, detail: str, limit: int = 0, level: str = "error") -> DataFrame:
    """One-row check: ok while the count of bad rows is within ``limit``."""
    n = df.agg(F.count_if(bad).alias("n_bad"))
    text = F.concat(F.col("n_bad").cast("string"), F.lit(f" {detail}"))
    return n.select(
        F.lit(name).alias("check"),
        (F.col("n_bad") <= limit).alias("ok"),
        F.lit(level).alias("level"),
        F.col("n_bad"),
        F.when(F.col("n_bad") > limit, text).otherwise("").alias("detail"),
    )


def data_gate(
    manifest: DataFrame,
    unresolved: DataFrame,
    shootouts: DataFrame,
    matches: DataFrame,
    dated: dict[str, tuple[DataFrame, str]],
    *,
    now: Column | None = None,
    unresolved_threshold: int = 0,
    label: str = "home_wins_tie",
) -> DataFrame:
    """Duplicate keys, label present, unresolved names, unmatched shootouts, future-dated rows."""
    at = F.current_timestamp() if now is None else now
    always = F.lit(True)
    checks = [
        check_row(duplicate_keys(manifest), "manifest:no_duplicates", always, "duplicate keys"),
        check_row(manifest, "manifest:advancement_label_is_bool", F.col(label).isNull(), "ambiguous labels"),
        check_row(
            unresolved, "aliases:unresolved_under_threshold", always, "unresolved names", unresolved_threshold
        ),
        check_row(
            unmatched_shootouts(shootouts, matches), "shootouts:all_matched", always, "unmatched shootout rows"
        ),
    ]
    for name, (df, ts) in dated.items():
        checks.append(
            check_row(df, f"no_post_cutoff_records:{name}", F.col(ts) > at, "future-dated rows")
        )
    return reduce(DataFrame.unionByName, checks)


def gate_verdict(checks: DataFrame, strict: bool = False) -> DataFrame:
    """One row: passed, number of checks, number of failed errors."""
    failed = ~F.col("ok") & (F.col("level") == "error")
    v = checks.agg(
        (F.count_if(failed) == 0).alias("passed"),
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(failed).alias("n_failed"),
    )
    if strict:
        ok = F.assert_true("passed", F.lit("data gate failed"))
        v = v.withColumn("_g", ok).filter(F.col("_g").isNull()).drop("_g")
    return v


def content_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 per file of a ``binaryFile`` listing."""
    return files.select("path", F.sha2(F.col(content), 256).alias("actual_sha256"))


#: Bytes of a file that a task holds at once.
PIECE = 8 << 20


def file_hashes(paths: DataFrame, piece: int = PIECE, path: str = "path") -> DataFrame:
    """(path, actual_sha256) of files of any size: tasks read each file in pieces through its file system. Null for a file that
    cannot be read. Paths must be reachable from the executors."""

    def run(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            found = []
            for p in pdf[path]:
                try:
                    system, inner = fs.FileSystem.from_uri(p if "://" in p or p.startswith("/") else p.replace(":/", ":///", 1))
                    digest = hashlib.sha256()
                    with system.open_input_stream(inner, compression=None) as f:
                        while part := f.read(piece):
                            digest.update(part)
                    found.append(digest.hexdigest())
                except (OSError, ValueError):
                    found.append(None)
            yield pd.DataFrame({"path": pdf[path], "actual_sha256": found})

    return paths.select(path).mapInPandas(run, "path string, actual_sha256 string")


def content_integrity(hashes: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded (path, raw_sha256) against actual hashes; a missing file fails."""
    j = recorded.join(hashes, "path", "left")
    return j.select(
        "path",
        F.coalesce(F.col("actual_sha256") == F.col("raw_sha256"), F.lit(False)).alias("ok"),
        F.when(F.col("actual_sha256").isNull(), "file missing")
        .when(F.col("actual_sha256") != F.col("raw_sha256"), "hash differs")
        .otherwise("")
        .alias("detail"),
    )


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the test side that are also in the training side of the same fold: must be empty."""
    return test.join(train.select(*keys).distinct(), keys, "left_semi")


def coverage_report(
    registry: DataFrame, queue: DataFrame, classified: DataFrame, features: DataFrame, flags: list[str]
) -> DataFrame:
    """(metric, value) rows: alias counts, manifest totals, share of rows with each feature block."""
    parts = [
        registry.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("alias_entries").alias("metric"), "value"),
        queue.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("unresolved_names").alias("metric"), "value"),
        classified.groupBy(F.concat(F.lit("manifest:"), F.coalesce("reason", F.lit("accepted"))).alias("metric")).agg(
            F.count(F.lit(1)).cast("double").alias("value")
        ),
    ]
    shares = features.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    rows = F.array(*[F.struct(F.lit(f"coverage:{f}").alias("metric"), F.col(f).alias("value")) for f in flags])
    parts.append(shares.select(F.explode(rows).alias("s")).select("s.*"))
    return reduce(DataFrame.unionByName, parts)
