"""Upserts of stored tables that rewrite only the partitions a batch touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cutline.plans.store import materialize

#: Parts of a stored table. A batch rewrites the parts of its keys, so small batches want many.
PARTS = 256
_STEM = "part_of_"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and the table's path in it, whatever scheme the path has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _check_layout(spark: SparkSession, path: str, column: str) -> bool:
    """Whether the table exists; raises where it was laid out in another way."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return False
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
    other = [n for n in names if not n.startswith(("_", ".")) and not n.startswith(f"{column}=")]
    if other:
        raise ValueError(f"{path} is laid out by {other[0].partition('=')[0]}, not by {column}")
    return any(n.startswith(f"{column}=") for n in names)


def read_parts(spark: SparkSession, path: str, schema: StructType, parts: int = PARTS) -> DataFrame:
    """The stored table without its part column; no rows where nothing was stored yet."""
    return _read(spark, path, schema, f"{_STEM}{parts}").select(*schema.names)


def _read(spark: SparkSession, path: str, schema: StructType, column: str) -> DataFrame:
    full = StructType([*schema.fields]).add(column, IntegerType())
    if not _check_layout(spark, path, column):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def upsert_parts(
    path: str,
    batch: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: StructType,
    key: str = "match_id",
    parts: int = PARTS,
) -> list[int]:
    """Bring a batch into the table at ``path`` and return the parts that were written.

    A row's part is a hash of its key, so that the parts a batch touches are known from the batch alone and no part is
    hot (keys are unique in the stored table). Only these parts are read (partition pruning) and overwritten; the
    files of all others stay as they are. ``merge(stored rows, batch)`` gives the new state of those parts, such as
    ``upsert_matches`` or ``upsert_results``; columns beyond ``schema`` are left out. The new state is written to the
    shared folder before the first file is replaced. One writer at a time. Null keys share a part; an empty batch writes nothing.
    """
    spark, column = batch.sparkSession, f"{_STEM}{parts}"
    touched = sorted(r[0] for r in batch.select(_part(key, parts)).distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return touched
    stored = _read(spark, path, schema, column).where(F.col(column).isin(touched)).select(*schema.names)
    state = materialize(merge(stored, batch).select(*schema.names, _part(key, parts).alias(column)), "upsert")
    # A part is one file: its rows meet in one task, which holds a share of 1 / parts of the table at most.
    out = state.repartition(len(touched), column)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return touched
