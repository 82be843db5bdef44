"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.session import checkpoint_dir

#: Code points that separate words: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


#: Bytes of texts that Spark hands to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by size rather than by rows alone: ten thousand long texts would not fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder of the cluster."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: work that several jobs use is done once, and a lost
    executor repeats tasks of one job only."""
    bounded_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stored``, with the rows dealt by a hash of ``key``: joins on the key read them where they are, without a shuffle. The catalog's
    entry goes at once; the files stay in the shared folder."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, name)
    entry = f"cutline_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(entry, format="parquet")
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def words_in(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text, a bounded piece of it at a time."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size:
            gap = _SPACE.search(data, at + size)
            end = gap.start() if gap else end
        yield data[at:end].split()
        at = end
