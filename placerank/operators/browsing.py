"""Finding a reference listing: filters, search, choices and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.constants import DISPLAY_HEADERS, PICKER_COLUMNS
from placerank.functions.expressions import present, seeded_order

_SEARCHED = [
    "listing_title", "room_type_text", "addr_name", "addr_cc", "price_per_night", "ratings",
]


def _within(name: str, low: float | None, high: float | None) -> Column:
    """Inclusive range; an open end is no limit, and a used range fails null."""
    value = F.col(name)
    if low is None and high is None:
        return F.lit(True)
    if low is None:
        return value <= high
    if high is None:
        return value >= low
    return value.between(low, high)


def filter_listings(
    df: DataFrame,
    country: str | None = None,
    city: str | None = None,
    rating: tuple[float | None, float | None] = (None, None),
    price: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """Listings that pass every filter that is used."""
    kept = df.where(_within("ratings", *rating)).where(_within("price_per_night", *price))
    if country and country.strip():
        kept = kept.where(F.upper(F.trim("addr_cc")) == country.strip().upper())
    if city and city.strip():
        kept = kept.where(F.trim("addr_name") == city.strip())
    return kept


def browse(df: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """The picker's columns of the filtered listings, best rated and cheapest first.

    All of them without a ``limit``, else at least one.
    """
    found = (
        filter_listings(df, **filters)
        .select(*present(df, PICKER_COLUMNS))
        .orderBy(F.desc_nulls_last("ratings"), F.asc_nulls_last("price_per_night"), "property_id")
    )
    return found if limit is None else found.limit(max(1, int(limit)))


def search(df: DataFrame, text: str, columns: Sequence[str] = tuple(_SEARCHED)) -> DataFrame:
    """Rows whose shown text holds ``text``, upper and lower case alike."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present(df, columns)]
    return df.where(F.contains(F.lower(F.concat_ws(" ", *shown)), F.lit((text or "").lower())))


def country_choices(df: DataFrame) -> DataFrame:
    code = F.upper(F.trim("addr_cc"))
    return df.select(code.alias("addr_cc")).where("addr_cc <> ''").distinct().orderBy("addr_cc")


def city_choices(df: DataFrame, country: str) -> DataFrame:
    return (
        df.where(F.col("addr_cc") == country)
        .select(F.trim("addr_name").alias("addr_name"))
        .where("addr_name <> ''")
        .distinct()
        .orderBy("addr_name")
    )


def with_label(df: DataFrame) -> DataFrame:
    """One line of text that tells listings apart in a list."""

    def text(name: str, missing: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(missing))

    label = F.concat(
        text("listing_title", ""), F.lit(" — "), text("addr_name", ""),
        F.lit(" ("), text("addr_cc", ""), F.lit(") | $"), text("price_per_night", "None"),
        F.lit(" | ⭐ "), text("ratings", "None"),
    )
    return df.withColumn("label", label)


def with_headers(
    df: DataFrame, columns: Sequence[str], headers: Mapping[str, str] = DISPLAY_HEADERS
) -> DataFrame:
    """The shown columns under their display names."""
    return df.select(*[F.col(c).alias(headers.get(c, c)) for c in present(df, columns)])


def sample_listings(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` listings in an order that depends on the seed alone, ids as text."""
    return (
        df.select(*present(df, PICKER_COLUMNS))
        .dropna(subset=["property_id", "addr_cc"])
        .withColumn("property_id", F.col("property_id").cast("string"))
        .orderBy(seeded_order(seed, "property_id"), "property_id")
        .limit(int(n))
    )
