"""Interpretable scores, each relative to the listing's country.

The country extremes come from one aggregate that is written once and joined
back.  Window functions over a country would put the whole of the largest
country into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.constants import BUDGET_RANKS, ENV_COLUMNS, RATING_COLUMNS
from placerank.functions.expressions import as_double, present, safe_divide
from placerank.operators.nested import monthly_temperatures
from placerank.sources.scratch import written


def budget_rank(level: Column) -> Column:
    """1, 2 or 3 for a known budget level, else null."""
    pairs = [F.lit(v) for pair in BUDGET_RANKS.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), level)


def _price_per_guest(null_ppg: bool) -> Column:
    quotient = F.try_divide(as_double("price_per_night"), as_double("guests"))
    return quotient if null_ppg else F.coalesce(quotient, F.lit(0.0))


def _log_count(name: str) -> Column:
    return F.log1p(F.coalesce(as_double(name), F.lit(0.0)))


def listing_inputs(df: DataFrame, null_ppg: bool = False) -> DataFrame:
    """Per-row quantities that the country extremes are taken of.

    A missing price or guest count gives a price per guest of 0, the cheapest of
    its country; ``null_ppg`` leaves it null and scores it 0 instead.
    """
    return df.withColumns(
        {
            "PPG": _price_per_guest(null_ppg),
            "reviews_log": _log_count("property_number_of_reviews"),
            "h_i": safe_divide(as_double("host_rating"), F.lit(5.0)),
            "e_i": _log_count("host_number_of_reviews"),
            "r_i": safe_divide(as_double("host_response_rate"), F.lit(100.0)),
            "T_i": as_double("hosts_year"),
        }
    )


def country_extremes(df: DataFrame, env: Sequence[str] = ()) -> DataFrame:
    """One row per country with every minimum and maximum the scores need."""
    have = set(df.columns)
    aggregates = []
    if "PPG" in have:
        aggregates += [
            F.min("PPG").alias("PPG_min"),
            F.max("PPG").alias("PPG_max"),
            F.max("reviews_log").alias("reviews_log_max"),
            F.max("e_i").alias("e_max"),
            F.max("T_i").alias("T_max"),
        ]
    aggregates += [F.max(as_double(c)).alias(f"{c}_max") for c in present(df, env)]
    return df.groupBy("addr_cc").agg(*aggregates)


def attach_extremes(df: DataFrame, env: Sequence[str] = ()) -> DataFrame:
    """The country's extremes beside every row; rows without a country form one group."""
    extremes = written(country_extremes(df, env), "extremes").withColumnRenamed(
        "addr_cc", "extremes_cc"
    )
    same = F.col("addr_cc").eqNullSafe(F.col("extremes_cc"))
    return df.join(extremes, same, "left").drop("extremes_cc")


def _add_price_score(df: DataFrame) -> DataFrame:
    low, high = F.col("PPG_min"), F.col("PPG_max")
    cheapness = 1.0 - F.try_divide(F.col("PPG") - low, high - low)
    return df.withColumn("price_score", F.coalesce(cheapness, F.lit(0.0)))


def _add_property_quality(df: DataFrame) -> DataFrame:
    categories = present(df, RATING_COLUMNS.values())
    mean = F.lit(None).cast("double")
    if categories:
        mean = sum((as_double(c) for c in categories[1:]), as_double(categories[0]))
        mean = mean / F.lit(float(len(categories)))
    weight = F.col("reviews_weight")
    favourite = F.coalesce(as_double("is_guest_favorite"), F.lit(0.0))
    return (
        df.withColumns(
            {
                "category_rating_avg": mean,
                "rating01": safe_divide(as_double("ratings"), F.lit(5.0)),
                "reviews_weight": safe_divide(F.col("reviews_log"), F.col("reviews_log_max")),
            }
        )
        .withColumn("category_rating01", safe_divide(F.col("category_rating_avg"), F.lit(5.0)))
        .withColumn("rating_score", 0.6 * F.col("rating01") + 0.4 * F.col("category_rating01"))
        .withColumn(
            "property_quality",
            0.8 * (F.col("rating_score") * weight + 0.5 * (1.0 - weight)) + 0.2 * favourite,
        )
    )


def _add_host_quality(df: DataFrame) -> DataFrame:
    rating, confidence = F.col("h_i"), F.col("e_norm")
    superhost = F.coalesce(as_double("is_supperhost"), F.lit(0.0))
    return (
        df.withColumns(
            {
                "e_norm": safe_divide(F.col("e_i"), F.col("e_max")),
                "T_norm": safe_divide(F.col("T_i"), F.col("T_max")),
            }
        )
        .withColumns(
            {
                "h_conf": confidence * rating + (1.0 - confidence) * 0.5,
                "tenure_effect": F.col("T_norm") * (rating - 0.5),
            }
        )
        .withColumn(
            "host_quality",
            0.6 * F.col("h_conf") + 0.1 * F.col("r_i") + 0.1 * superhost
            + 0.2 * F.col("tenure_effect"),
        )
    )


def _add_environment_norms(df: DataFrame, env: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {
            f"{c}_norm": safe_divide(as_double(c), F.col(f"{c}_max"))
            for c in present(df, env)
        }
    )


def listing_scores(df: DataFrame, null_ppg: bool = False) -> DataFrame:
    """``price_score``, ``property_quality`` and ``host_quality``."""
    ranged = attach_extremes(listing_inputs(df, null_ppg))
    return _add_host_quality(_add_property_quality(_add_price_score(ranged)))


def environment_scores(df: DataFrame, env: Sequence[str] = tuple(ENV_COLUMNS)) -> DataFrame:
    """``env_*_max`` and ``env_*_norm``, the count relative to the country's largest."""
    return _add_environment_norms(attach_extremes(df, env), env)


def city_scores(df: DataFrame) -> DataFrame:
    """Monthly temperatures, if the city facts hold them, and the budget rank."""
    out = monthly_temperatures(df) if "avg_temp_monthly" in df.columns else df
    return out.withColumn("budget_rank", budget_rank(F.col("budget_level")))


def score_all(
    df: DataFrame, env: Sequence[str] = tuple(ENV_COLUMNS), null_ppg: bool = False
) -> DataFrame:
    """All scores with a single pass for all country extremes."""
    ranged = attach_extremes(listing_inputs(df, null_ppg), env)
    scored = _add_host_quality(_add_property_quality(_add_price_score(ranged)))
    return city_scores(_add_environment_norms(scored, env))
