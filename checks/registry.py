"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.shipping import ship_package
from checks.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shipped(run: Callable[[SparkSession, str], DataFrame]):
    """``run`` with the package handed to the Python workers first."""

    @wraps(run)
    def call(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return run(spark, folder)

    return call


def query(
    name: str,
    views: Sequence[str] = (),
    select: str | None = None,
    steps: dict[str, str] | None = None,
):
    """Register a query; ``select`` over ``views`` and ``steps`` is its SQL twin."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = shipped(run)
        if select is not None:
            ORACLES[name] = with_views(list(views), select, steps)
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
