"""Feature snapshots as a stored table: built once for each key, found again by cut-off day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.operators.ingest import make_snapshots
from cutline.plans.store import materialize

KEYS = ["match_id", "cutoff_time", "feature_version"]
SCHEMA = "match_id {id}, cutoff_time timestamp, feature_version string, features_json string, source_data_max_timestamp timestamp, immutable_hash string"
DAY = "cutoff_day"


def read_snapshots(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """All stored snapshots with the partition column ``cutoff_day``; none where nothing was stored yet."""
    schema = f"{SCHEMA.format(id=id_type)}, {DAY} date"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def extend_snapshots(
    path: str, asked: DataFrame, build: Callable[[DataFrame], DataFrame], feature_version: str, feature_columns: list[str]
) -> DataFrame:
    """The snapshots of the asked (match_id, cutoff_time), after those not stored yet were built and added at ``path``.

    The table is partitioned by the day of the cut-off, and only the days between the first and the last asked for are read, those
    of the join with the asked days among them. ``build`` gets a spine of the missing keys alone and is not called where there are
    none, so a second run reads no history. Stored rows are never rewritten: files are only added. Repeated keys count once; rows
    without match or cut-off cannot be keys and are left out. One writer at a time.
    """
    spark = asked.sparkSession
    id_type = asked.schema["match_id"].dataType.simpleString()
    day = F.to_date("cutoff_time")
    want = asked.select("match_id", "cutoff_time", F.lit(feature_version).alias("feature_version"), day.alias(DAY))
    want = materialize(want.where("match_id is not null and cutoff_time is not null").distinct(), "asked")
    first, last = want.agg(F.min(DAY), F.max(DAY)).first()
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    if first is None:
        return read_snapshots(spark, path, id_type).limit(0).select(*columns)

    def found() -> DataFrame:
        return read_snapshots(spark, path, id_type).where(F.col(DAY).between(first, last)).join(want, [*KEYS, DAY], "left_semi")

    todo = materialize(want.join(found().select(*KEYS), KEYS, "left_anti").select("match_id", "cutoff_time"), "missing")
    if not todo.isEmpty():
        fresh = make_snapshots(build(todo), feature_version, feature_columns).withColumn(DAY, day)
        # A day with very many keys is cut by match, so that no task holds a whole day.
        fresh.repartition(DAY, F.pmod(F.xxhash64("match_id"), F.lit(8))).write.mode("append").partitionBy(DAY).parquet(path)
    return found().select(*columns)
