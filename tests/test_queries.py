"""Every registered query against its SQL twin on tables large enough that none is empty."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import ORACLES, QUERIES
from checks.run import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    verdict = compare(spark, duck, FOLDER, QUERIES[name], ORACLES.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry_module_has_them_all():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
