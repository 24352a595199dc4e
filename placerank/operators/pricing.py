"""Nightly price, currency and imputation by country."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.constants import IMPUTED_COLUMNS, USD_RATES
from placerank.functions.expressions import present
from placerank.sources.scratch import written


def derive_nightly_price(df: DataFrame, negative_per_night: bool = False) -> DataFrame:
    """``price_per_night`` by the first rule that gives a value, to two decimals.

    The rules: the stated price, the initial price, the price without fees per
    night, the total less all fees per night, the total per night.  A negative
    outcome is replaced by ``total_price``, unrounded; ``negative_per_night``
    divides that by the number of nights.
    """
    nights = F.col("num_of_nights")
    total = F.col("total_price")
    fees = (
        F.col("airbnb_service_fee") + F.col("cleaning_fee") + F.col("taxes")
        + F.col("special_offer")
    )
    price = F.coalesce(
        "price_per_night",
        "initial_price_per_night",
        F.try_divide("price_without_fees", nights),
        F.try_divide(total - fees, nights),
        F.try_divide(total, nights),
    )
    fallback = F.try_divide(total, nights) if negative_per_night else total
    return df.withColumn("price_per_night", price).withColumn(
        "price_per_night",
        F.when(F.col("price_per_night") < 0, fallback).otherwise(
            F.round("price_per_night", 2)
        ),
    )


def prices_to_usd(
    df: DataFrame,
    money: Sequence[str] = ("price_per_night",),
    rates: Mapping[str, float] = USD_RATES,
    unknown: str = "keep",
) -> DataFrame:
    """Prices in the currencies of ``rates`` become USD, to two decimals.

    Other currencies keep their amount and label; with ``unknown="null"`` the
    amounts of currencies that are neither USD nor in ``rates`` become null.
    """
    currency = F.col("currency")
    rate = F.when(currency.isNull(), F.lit(1.0))
    for code, value in rates.items():
        rate = rate.when(currency == code, F.lit(float(value)))
    if unknown == "null":
        rate = rate.when(currency == "USD", F.lit(1.0))
    else:
        rate = rate.otherwise(F.lit(1.0))
    converted = {c: F.round(F.col(c) * rate, 2) for c in present(df, money)}
    label = F.when(currency.isin(list(rates)), F.lit("USD")).otherwise(currency)
    return df.withColumns(converted).withColumn("currency", label)


def imputation_means(
    df: DataFrame, columns: Sequence[str] = tuple(IMPUTED_COLUMNS)
) -> DataFrame:
    """Means per country and over everything, to two decimals, in one pass.

    The overall row is the one with ``is_overall = 1``; a null country has a
    row of its own.
    """
    # The last digits of a sum of doubles depend on the order of the tasks.  They
    # are rounded off first, or a mean that ends in a half could go either way.
    means = [F.round(F.round(F.avg(c), 9), 2).alias(f"avg_{c}") for c in columns]
    return (
        df.groupingSets([[F.col("addr_cc")], []], "addr_cc")
        .agg(F.grouping("addr_cc").cast("int").alias("is_overall"), *means)
    )


def impute(
    df: DataFrame, columns: Sequence[str] = tuple(IMPUTED_COLUMNS)
) -> DataFrame:
    """Null values become the country's mean, or else the overall mean.

    The means are written once, so that the join sees their real size, and the
    overall row is read as a scalar.
    """
    means = written(imputation_means(df, columns), "means")
    overall = means.where("is_overall = 1")
    by_country = means.where("is_overall = 0 and addr_cc is not null").drop("is_overall")
    filled = {
        c: F.coalesce(
            F.col(c).cast("double"),
            F.col(f"avg_{c}"),
            overall.select(f"avg_{c}").scalar(),
        )
        for c in columns
    }
    return (
        df.join(by_country, "addr_cc", "left")
        .withColumns(filled)
        .select(*df.columns)
    )
