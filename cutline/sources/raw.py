"""Shared pieces of the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.names import trim_all

# Words that read as true.
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header as text columns plus ``ordinal``, the position in the source."""
    df = spark.read.csv(path, header=True, multiLine=False, escape='"')
    where = F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )
    return df.select("*", where.alias("ordinal"))


def rename_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Lower-case, trim and map header names; unknown columns keep their name, the last of two
    columns with one meaning stands."""
    lookup = {a: name for name, names in aliases.items() for a in names}
    final: dict[str, Column] = {}
    for c in df.columns:
        key = c.lower().strip()
        final[lookup.get(key, key)] = F.col(f"`{c}`")
    return df.select(*[col.alias(name) for name, col in final.items()])


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Add absent columns as null text."""
    new = {c: F.lit(None).cast("string") for c in names if c not in df.columns}
    return df.withColumns(new) if new else df


def to_int(c: str | Column) -> Column:
    """``"3"`` and ``"3.0"`` read as 3; anything else is null."""
    text = trim_all(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"))


def to_bool(c: str | Column) -> Column:
    text = F.lower(trim_all(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(text.isin(*TRUE_WORDS), F.lit(False))


def check_schema(df: DataFrame, expected: list[str]) -> None:
    """Fail with the list of missing columns."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
