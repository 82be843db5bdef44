"""Order-invariant content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(columns: list[str]) -> Column:
    """SHA-256 over the compact JSON of the named columns in name order.

    Deterministic and independent of column order. Nulls are kept, so a null and an absent column
    differ. Doubles print as the JVM prints them, so the digest is not byte-equal to other tools.
    """
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)
