from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000  # over a megabyte


@pytest.fixture
def documents(spark):
    """Documents with columns of any name; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) + tuple("x" for _ in extra) for r in rows]
        names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{e}` string" for e in extra)
        return spark.createDataFrame(full, names)

    return make
