"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.catalog.bindings import Views, sql_with
from cutline.session import ensure_session


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()):
        """Register ``fn(v: Views) -> DataFrame``; ``sql`` may use the named views."""

        def wrap(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return tidy(fn(Views(ensure_session(spark), sf_dir)))

            run.__name__ = name
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql_with(views, sql)
            return fn

        return wrap


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 digits, timestamps without zone."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if t == "double":
            c = F.round(c, 6) + F.lit(0.0)
        elif t == "timestamp":
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)
