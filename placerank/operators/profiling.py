"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.functions.expressions import seeded_share
from placerank.operators.selection import exact_quantiles
from placerank.sources.scratch import written

_NUMERIC = (T.DoubleType, T.IntegerType, T.FloatType, T.LongType)
_UNPROFILED_TEXT = ["addr_cc", "currency", "category", "cancellation_policy"]
_ACCURACY = 5000


def _stacked(row: DataFrame, labels: Sequence[str], fields: Sequence[str], names: str) -> DataFrame:
    """One row with columns ``<label>__<field>`` turned into one row per label."""
    cells = []
    for label in labels:
        cells.append("'" + label.replace("'", "\\'") + "'")
        cells += [f"`{label}__{field}`" for field in fields]
    return row.selectExpr(f"stack({len(labels)}, {', '.join(cells)}) as ({names})")


def missing_values(df: DataFrame, show_all: bool = False) -> DataFrame:
    """Missing and present values per column, most incomplete first."""
    columns = df.columns
    counts = [F.count(F.col(f"`{c}`")).alias(f"{c}__present") for c in columns]
    totals = [F.count(F.lit(1)).alias(f"{c}__total") for c in columns]
    long = _stacked(
        df.agg(*counts, *totals), columns, ["present", "total"], "`column`, present, total"
    )
    missing = F.col("total") - F.col("present")

    def percent(part: Column) -> Column:
        return F.round(F.try_divide(part * 100.0, F.col("total")), 2)

    report = long.select(
        "column",
        missing.alias("missing"),
        percent(missing).alias("missing_pct"),
        "present",
        percent(F.col("present")).alias("present_pct"),
    )
    if not show_all:
        report = report.where("missing > 0")
    return report.orderBy(F.desc("missing_pct"), "column")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers that are neither flags nor identifiers, going by their names."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, _NUMERIC)
        and not f.name.startswith("is_")
        and "id" not in f.name.lower()
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in _UNPROFILED_TEXT
    ]


def _profiled(
    df: DataFrame, numbers: Sequence[str] | None, texts: Sequence[str] | None
) -> DataFrame:
    """Numbers as they are and texts by their length."""
    numbers = numeric_columns(df) if numbers is None else list(numbers)
    texts = text_columns(df) if texts is None else list(texts)
    return df.select(*numbers, *[F.length(c).alias(f"len_{c}") for c in texts])


def quartile_fences(
    df: DataFrame, columns: Sequence[str], iqr_multiplier: float, exact: bool = False
) -> DataFrame:
    """Statistics and outlier fences per column, in long form.

    Quartiles come from mergeable sketches in one pass, or are ``exact`` ones that take some
    passes more; no task ever holds a column either way.
    """
    shares = [0.25, 0.5, 0.75]
    known = exact_quantiles(df, columns, shares, interpolated=False) if exact else {}
    aggregates = []
    for c in columns:
        if exact:
            quartiles = F.array(*[F.lit(v).cast("double") for v in known[c]])
        else:
            quartiles = F.percentile_approx(c, shares, _ACCURACY)
        aggregates += [
            F.count(c).alias(f"{c}__non_null"),
            F.min(c).cast("double").alias(f"{c}__min"),
            F.max(c).cast("double").alias(f"{c}__max"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev(c).alias(f"{c}__std"),
            quartiles.cast("array<double>").alias(f"{c}__quartiles"),
        ]
    fields = ["non_null", "min", "max", "mean", "std", "quartiles"]
    names = "feature, non_null, min, max, mean, std, quartiles"
    long = _stacked(df.agg(*aggregates), columns, fields, names)
    q = F.col("quartiles")
    spread = F.col("q75") - F.col("q25")
    iqr = F.when(spread == 0, F.lit(0.01)).otherwise(spread)
    return (
        long.withColumns({"q25": q[0], "median": q[1], "q75": q[2]})
        .drop("quartiles")
        .withColumns(
            {
                "lower_fence": F.col("q25") - iqr_multiplier * iqr,
                "upper_fence": F.col("q75") + iqr_multiplier * iqr,
            }
        )
    )


def outlier_counts(
    df: DataFrame, fences: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Values outside the fences per column, counted in one further pass.

    ``fences`` has one row per column; it is read back as one map so that every
    row of the data is looked at once and nothing is joined.
    """
    limits = fences.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("feature", F.struct("lower_fence", "upper_fence"))
            )
        )
    ).scalar()
    counts = []
    for c in columns:
        limit = F.try_element_at(limits, F.lit(c))
        outside = (F.col(c) < limit["lower_fence"]) | (F.col(c) > limit["upper_fence"])
        counts.append(F.count_if(outside).alias(f"{c}__outliers"))
    return _stacked(df.agg(*counts), columns, ["outliers"], "feature, outliers")


def distribution_report(
    df: DataFrame,
    numbers: Sequence[str] | None = None,
    texts: Sequence[str] | None = None,
    iqr_multiplier: float = 1.5,
    skip_all_null: bool = True,
    exact: bool = True,
) -> DataFrame:
    """Distribution and outliers of numeric columns and of text lengths.

    Quartiles are exact, at the price of further passes over the profiled columns, which are
    written once for them; without ``exact`` they are sketches.

    The fences are a few rows; they are written once and read by both the last
    pass and the report.
    """
    checked = _profiled(df, numbers, texts)
    if exact:
        checked = written(checked, "profiled")
    columns = checked.columns
    fences = written(quartile_fences(checked, columns, iqr_multiplier, exact), "fences")
    outside = outlier_counts(checked, fences, columns)
    report = fences.join(outside, "feature")
    if skip_all_null:
        report = report.where("non_null > 0")
    shown = ["min", "q25", "median", "mean", "std", "q75", "max", "lower_fence", "upper_fence"]
    return report.select(
        "feature", "non_null", *[F.round(c, 2).alias(c) for c in shown], "outliers"
    )


def histogram(df: DataFrame, column: str, bins: int = 30, log_scale: bool = False) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty ones left out.

    ``log_scale`` makes the bins equally wide in the logarithm and leaves out
    values that have none.
    """
    value = F.col(column).cast("double")
    values = df.select((F.log(value) if log_scale else value).alias("value")).where(
        "value is not null" + (" and value > double('-infinity')" if log_scale else "")
    )
    edge = values.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    low, high = edge.select("low").scalar(), edge.select("high").scalar()
    width = (high - low) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - low, width)), F.lit(0))
    counted = values.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n_rows")
    )
    start = low + F.col("bin") * width
    end = low + (F.col("bin") + 1) * width
    if log_scale:
        start, end = F.exp(start), F.exp(end)
    return counted.select("bin", start.alias("bin_start"), end.alias("bin_end"), "n_rows")


def sample_rows(
    df: DataFrame,
    fraction: float,
    seed: int = 42,
    max_rows: int | None = None,
    keys: Sequence[str] = ("property_id",),
) -> DataFrame:
    """A uniform sample without replacement by a hash of ``keys``, then at most ``max_rows`` of it."""
    sampled = df.where(seeded_share(fraction, seed, *keys))
    return sampled if max_rows is None else sampled.limit(max_rows)
