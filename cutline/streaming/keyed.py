"""Content-hash append with the known hashes as state: a micro-batch costs its own size, not the table's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_stream(stream: DataFrame, hash_col: str = "raw_payload_hash", order: list[str] | None = None) -> DataFrame:
    """Rows of the stream whose hash was never seen before; of equal hashes in a micro-batch the first by ``order``, or any
    one without ``order`` (a content hash names equal content; this form stays in the JVM and is the one for large streams, the
    ordered one calls Python for each hash of a micro-batch).

    The hashes live in the query's state store, partitioned by hash, so the table written so far is never read. Write the
    result with a sink in append mode; with its checkpoint a repeated micro-batch adds nothing. State grows with the number of
    distinct hashes (a flag each): use the RocksDB provider where it outgrows memory. Of a hash that floods one
    micro-batch only the first row is held at a time. Rows of a null hash count as one hash.
    """
    if order is None:
        return stream.dropDuplicates([hash_col])

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for rows in batches:
            if state.exists:
                continue
            rows = rows if best is None else pd.concat([best, rows], ignore_index=True)
            best = rows.sort_values(order, kind="stable", na_position="first").head(1)
        if best is not None and not state.exists:
            state.update((True,))
            yield best

    return stream.groupBy(hash_col).applyInPandasWithState(first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)
