"""Queries that SQL can express against their SQL, and what is registered."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from checks.run import compare, connect
from placerank.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees_with_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]).startswith("ok")


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert len(corpus_pipeline.STAGES) == 5
