"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cutline.session import checkpoint_dir


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that ended. It does so when the driver's JVM collects what refers to them, by default perhaps not for half an
    hour, and until then the files of all jobs of a query add up."""
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many: for tables that several jobs use. What earlier tables shuffled is released before (the last of them may still be
    referred to just after it was written), what this one shuffled as far as that is free."""
    release(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.parquet(path)
