"""Join and dedupe helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join that splits each key of ``big`` over ``salts`` tasks.

    Used where the result is aggregated on a superset of the join key: there the adaptive
    skew split is not applied (it would break the partitioning the aggregate reuses), so a hot
    key would stay in one task. ``small`` has few rows per key and is replicated ``salts`` times.
    The salt is a hash of the row, so a recomputed task yields the same split.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the big side's rows can be salted")
    if salts <= 1:
        return big.join(small, on, how)
    spread = [F.col(c) for c in big.columns]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def pick_row(
    df: DataFrame, keys: list[str], order: list[Column], last: bool = True
) -> DataFrame:
    """One whole row per key: the last (or first) by ``order``.

    A grouped ``max_by`` rather than ``row_number``: copies of one key are combined before the
    shuffle, so a key with a third of the rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)
