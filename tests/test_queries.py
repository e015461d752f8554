"""Every query against its SQL statement on the smallest tables."""

import re
from pathlib import Path

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not there")

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, con, name):
    got, expected = compare.spark_rows(QUERIES[name](spark, SF)), compare.sql_rows(con, ORACLES[name])
    assert got == expected


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    own = {n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)}
    assert own <= set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 150
