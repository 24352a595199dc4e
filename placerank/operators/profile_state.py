"""Profiles that grow with a table: mergeable states, one set for each batch that is written.

A state has a row per column with counts, moments, extremes and sketches, and a row per
distinct value of each number or text length with its count.  States of batches are kept
beside the table; the profile of all of it is merged from them, and no batch is read again.
Quantiles are exact as far as the values of all batches were counted, else of the sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.operators.profiling import numeric_columns, text_columns
from placerank.operators.selection import counted_quantiles
from placerank.sources.scratch import written

#: Size of a quantile sketch.  Up to about so many values quantiles are exact, beyond it
#: ranks are off by about one in its size; 65,535 at most.
ACCURACY = 4096
_FIELDS = ["kind", "total", "present", "mean", "m2", "low", "high", "quantiles", "distinct"]
_SHARES = [0.25, 0.5, 0.75]


def profile_state(
    df: DataFrame,
    numbers: Sequence[str] | None = None,
    texts: Sequence[str] | None = None,
    accuracy: int = ACCURACY,
    values: bool = True,
) -> DataFrame:
    """One row per column of ``df`` (kind ``column``) and per number or text length (``feature``).

    All are taken in one pass.  ``m2`` is the sum of squared deviations from ``mean``; sketches
    and ``distinct`` are binary.  Columns have counts and ``distinct`` alone.  A further pass
    adds a row per distinct value of a feature (kind ``value``): it is ``low`` and ``high``, and
    ``present`` so often.  Without ``values`` quantiles are those of the sketches.
    """
    numbers = numeric_columns(df) if numbers is None else list(numbers)
    texts = text_columns(df) if texts is None else list(texts)
    features = {n: F.col(f"`{n}`").cast("double") for n in numbers}
    features |= {f"len_{t}": F.length(f"`{t}`").cast("double") for t in texts}
    rows = {}
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("binary")
    for c in df.columns:
        # A sketch takes no empty text, so each gets a first character.
        text = F.concat(F.lit("="), F.col(f"`{c}`").cast("string"))
        distinct = F.when(F.count(text) > 0, F.hll_sketch_agg(text))
        rows["column", c] = [F.count(F.col(f"`{c}`")), none, none, none, none, empty, distinct]
    for name, v in features.items():
        sketch = F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, accuracy))
        m2 = F.var_pop(v) * F.count(v)
        rows["feature", name] = [F.count(v), F.avg(v), m2, F.min(v), F.max(v), sketch, empty]
    structs = [
        F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("total"),
            *[value.alias(field) for field, value in zip(_FIELDS[2:], values)],
        )
        for (kind, name), values in rows.items()
    ]
    state = df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))
    if not values or not features:
        return state
    cells = [F.struct(F.lit(name).alias("name"), v.alias("v")) for name, v in features.items()]
    counted = df.select(F.inline(F.array(*cells))).where("v is not null").groupBy("name", "v").count()
    return state.unionByName(_value_rows(counted.select("name", "v", F.col("count").alias("n"))))


def _value_rows(counted: DataFrame) -> DataFrame:
    """Rows of a state from ``name``, ``v`` and ``n``."""
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("binary")
    return counted.select(
        "name", F.lit("value").alias("kind"), F.col("n").alias("total"), F.col("n").alias("present"),
        none.alias("mean"), none.alias("m2"), F.col("v").alias("low"), F.col("v").alias("high"),
        empty.alias("quantiles"), empty.alias("distinct"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One state from those of several batches."""
    values = states.where("kind = 'value'").groupBy("name", F.col("low").alias("v"))
    states = states.where("kind <> 'value'")
    n = F.coalesce(F.sum(F.when(F.col("mean").isNotNull(), F.col("present"))), F.lit(0))
    whole = states.groupBy("name", "kind").agg(
        (F.sum(F.col("mean") * F.col("present")) / F.nullif(n, F.lit(0))).alias("whole_mean")
    )
    apart = F.col("mean") - F.col("whole_mean")
    facts = (
        states.join(whole, ["name", "kind"])
        .groupBy("name", "kind")
        .agg(
            F.sum("total").alias("total"), F.sum("present").alias("present"),
            F.first("whole_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("present") * apart * apart).alias("m2"),
            F.min("low").alias("low"), F.max("high").alias("high"),
            F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
            F.when(F.count("distinct") > 0, F.hll_union_agg("distinct")).alias("distinct"),
        )
    )
    return facts.unionByName(_value_rows(values.agg(F.sum("present").alias("n"))))


def append_profile(df: DataFrame, path: str, **options) -> None:
    """The state of one more batch, kept at ``path``."""
    profile_state(df, **options).write.mode("append").parquet(path)


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """The merged state of all batches kept at ``path``."""
    return merged(spark.read.parquet(path))


def missing_from_state(state: DataFrame, show_all: bool = False) -> DataFrame:
    """The report of ``missing_values`` from a state, with an estimate of distinct values."""
    missing = F.col("total") - F.col("present")

    def percent(part):
        return F.round(F.try_divide(part * 100.0, F.col("total")), 2)

    report = state.where("kind = 'column'").select(
        F.col("name").alias("column"), missing.alias("missing"), percent(missing).alias("missing_pct"),
        "present", percent(F.col("present")).alias("present_pct"),
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("distinct"),
    )
    if not show_all:
        report = report.where("missing > 0")
    return report.orderBy(F.desc("missing_pct"), "column")


def _exact_quartiles(state: DataFrame) -> dict[str, list[float]]:
    """Quartiles of the features whose values were counted in every batch."""
    counts = state.where("kind <> 'column'").groupBy("name", "kind").agg(F.sum("present").alias("n")).collect()
    seen = {(r["name"], r["kind"]): r["n"] for r in counts}
    whole = [name for (name, kind), n in seen.items() if kind == "value" and seen[name, "feature"] == n]
    values = state.where((F.col("kind") == "value") & F.col("name").isin(whole))
    return counted_quantiles(
        values.select(F.col("name").alias("at"), F.col("low").alias("v"), F.col("present").alias("n")),
        _SHARES, interpolated=False,
    )


def distribution_from_state(state: DataFrame, iqr_multiplier: float = 1.5) -> DataFrame:
    """The report of ``distribution_report`` from a state; outliers would need the values again.

    Jobs look the quartiles up in the counted values when it is called.
    """
    ranks = F.array(*[F.lit(q) for q in _SHARES])
    q = F.kll_sketch_get_quantile_double("quantiles", ranks)
    state = written(state, "state")
    if known := _exact_quartiles(state):
        cells = [x for name, found in known.items() for x in (F.lit(name), F.array(*map(F.lit, found)))]
        q = F.coalesce(F.try_element_at(F.create_map(*cells), F.col("name")), q)
    spread = F.col("q75") - F.col("q25")
    iqr = F.when(spread == 0, F.lit(0.01)).otherwise(spread)
    stats = (
        state.where("kind = 'feature' and present > 0")
        .withColumn("q", q)
        .select(
            F.col("name").alias("feature"), F.col("present").alias("non_null"), F.col("low").alias("min"),
            F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), "mean",
            F.when(F.col("present") > 1, F.sqrt(F.col("m2") / (F.col("present") - 1))).alias("std"),
            F.col("q")[2].alias("q75"), F.col("high").alias("max"),
        )
        .withColumns(
            {
                "lower_fence": F.col("q25") - iqr_multiplier * iqr,
                "upper_fence": F.col("q75") + iqr_multiplier * iqr,
            }
        )
    )
    return stats.select("feature", "non_null", *[F.round(c, 2).alias(c) for c in stats.columns[2:]])
