"""Exact quantiles of whole columns by narrowing histograms.

A pass counts the values of every interval that still holds a wanted rank in bins of equal
width, with the least and greatest value of each bin.  The bin that holds the rank becomes
the next interval, until it is a single value.  Only counts travel, a bounded number for each
column and quantile, and no task ever holds a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of an interval in one pass.
BINS = 512
_MOST = 1.7976931348623157e308


@dataclass
class _Wanted:
    """A rank, counted from 0, of a column; it lies in an interval after ``before`` values."""

    column: int | str
    rank: int
    low: float
    high: float
    before: int = 0


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers of all columns as rows of ``at``, ``v`` and ``n``, how often the number is there."""
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    return df.select(F.posexplode(F.array(*cells)).alias("at", "v"), F.lit(1).alias("n"))


def _finite(values: DataFrame) -> DataFrame:
    """Rows that hold a number, infinite ones as the greatest finite ones."""
    held = values.where("v is not null and not isnan(v)")
    return held.withColumn("v", F.greatest(F.least("v", F.lit(_MOST)), F.lit(-_MOST)))


def _narrowed(values: DataFrame, wanted: list[_Wanted], bins: int) -> None:
    """One pass: every rank gets the interval of its bin."""
    intervals = sorted({(w.column, w.low, w.high) for w in wanted})
    number = {interval: i for i, interval in enumerate(intervals)}
    by_column: dict[int | str, list[Column]] = {}
    for (column, low, high), i in number.items():
        fields = {"i": F.lit(i), "low": F.lit(low), "high": F.lit(high)}
        by_column.setdefault(column, []).append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    known = F.create_map(*[x for c, some in by_column.items() for x in (F.lit(c), F.array(*some))])
    v = F.col("v")
    held = F.filter(F.try_element_at(known, "at"), lambda s: v.between(s["low"], s["high"]))
    # Halves first, as the difference of two finite numbers may not be one.
    part = (v / 2 - F.col("s.low") / 2) / (F.col("s.high") / 2 - F.col("s.low") / 2)
    counted = (
        values.select("v", "n", F.explode(held).alias("s"))
        .groupBy("s.i", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin"))
        .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    found: dict[int, list] = {}
    for row in counted.collect():
        found.setdefault(row["i"], []).append(row)
    for rows in found.values():
        rows.sort(key=lambda r: r["bin"])
    for w in wanted:
        for row in found[number[w.column, w.low, w.high]]:
            if w.before + row["n"] > w.rank:
                w.low, w.high = row["low"], row["high"]
                break
            w.before += row["n"]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    interpolated: bool = True,
    bins: int = BINS,
) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, as doubles; a column without numbers has nulls.

    ``interpolated`` ones lie between two neighbouring values, others are the least value that
    at least that share of all reaches.  Nulls and NaN are no numbers.  Takes one pass for
    counts and usually two to four more over the columns, so runs jobs when called; a table
    that is dear to compute should be written first.
    """
    known = counted_quantiles(_values(df, columns), probabilities, interpolated, bins)
    return {c: known.get(at, [None] * len(probabilities)) for at, c in enumerate(columns)}


def counted_quantiles(
    values: DataFrame, probabilities: Sequence[float], interpolated: bool = True, bins: int = BINS
) -> dict[int | str, list[float]]:
    """Exact quantiles of every ``at`` of ``values``: a value ``v`` in it and how often, ``n``.

    As ``exact_quantiles``; an ``at`` without numbers has no entry.
    """
    values = _finite(values)
    spans = {r["at"]: r for r in values.groupBy("at").agg(
        F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    ).collect()}

    def position(n: int, q: float) -> float:
        return (n - 1) * q if interpolated else max(math.ceil(n * q) - 1, 0)

    ranks: dict[tuple[int | str, int], _Wanted] = {}
    for at, span in spans.items():
        for q in probabilities:
            place = position(span["n"], q)
            for rank in {math.floor(place), math.ceil(place)}:
                ranks.setdefault((at, rank), _Wanted(at, rank, span["low"], span["high"]))
    while open_ := [w for w in ranks.values() if w.low < w.high]:
        _narrowed(values, open_, bins)

    def value(at: int | str, q: float) -> float:
        place = position(spans[at]["n"], q)
        low, high = (ranks[at, rank].low for rank in (math.floor(place), math.ceil(place)))
        return low + (high - low) * (place - math.floor(place))

    return {at: [value(at, q) for q in probabilities] for at in spans}
