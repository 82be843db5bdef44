from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cutline import build_session

    s = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cutline-tests-"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def table(spark):
    """Small DataFrame from rows; text that looks like a time goes into timestamp columns."""
    from datetime import datetime

    from pyspark.sql.types import TimestampType, _parse_datatype_string

    def make(rows, schema):
        st = _parse_datatype_string(schema)
        times = [i for i, f in enumerate(st.fields) if isinstance(f.dataType, TimestampType)]

        def fix(row):
            row = list(row)
            for i in times:
                if isinstance(row[i], str):
                    row[i] = datetime.fromisoformat(row[i])
            return tuple(row)

        return spark.createDataFrame([fix(r) for r in rows], st)

    return make


def rows(df, *cols):
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=str)
