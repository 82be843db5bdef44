"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    status, detail, _, _ = compare(spark, con, SF, name, queries()[name], SQL[name])
    assert status == "ok", detail
    assert "types" not in detail


def test_every_twin_has_a_query():
    assert SQL.keys() <= queries().keys()


def test_entry(spark):
    assert entry(spark).columns[0] == "match_id"
