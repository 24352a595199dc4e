"""JSON text and nested values, as built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.constants import (
    BATHS_PATTERN,
    BEDROOMS_PATTERN,
    BEDS_PATTERN,
    NOT_INCLUDED_GROUP,
    RATING_COLUMNS,
    STUDIO_PATTERN,
    TEMPERATURE_COLUMNS,
)

_PRICING_SCHEMA = (
    "airbnb_service_fee double, cleaning_fee double, initial_price_per_night double, "
    "num_of_nights double, price_per_night double, price_without_fees double, "
    "special_offer double, taxes double"
)
_RATINGS_SCHEMA = "array<struct<name: string, value: string>>"
_AMENITIES_SCHEMA = (
    "array<struct<group_name: string, items: array<struct<name: string, value: string>>>>"
)
_TEMPERATURES_SCHEMA = "map<string, struct<avg: double, max: double, min: double>>"


def parse_pricing(df: DataFrame) -> DataFrame:
    """The fields of ``pricing_details`` as columns; nights become an integer."""
    parsed = F.from_json("pricing_details", _PRICING_SCHEMA)
    return (
        df.select("*", parsed.alias("pricing"))
        .select("*", "pricing.*")
        .withColumn("num_of_nights", F.col("num_of_nights").try_cast("int"))
        .drop("pricing", "pricing_details")
    )


def parse_ratings(df: DataFrame) -> DataFrame:
    """Six named ratings of ``category_rating``; the last of a repeated name wins."""
    entries = F.from_json("category_rating", _RATINGS_SCHEMA)

    def rating(name: str) -> Column:
        named = F.filter(F.col("entries"), lambda e: e["name"] == name)
        return F.try_element_at(named, F.lit(-1))["value"].try_cast("double")

    columns = {column: rating(name) for name, column in RATING_COLUMNS.items()}
    return df.withColumn("entries", entries).withColumns(columns).drop(
        "entries", "category_rating"
    )


_BLANKS = " \t\n\r\f\v"
_AMENITY = "array<struct<token: string, name: string, value: string, absent: boolean>>"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _items(column: str) -> Column:
    """The strings of a JSON list; no list, no strings."""
    text = F.col(column)
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def _strings(items: Column) -> Column:
    return F.filter(items, lambda item: item.isNotNull() & (item != ""))


def _first_number(text: Column, pattern: str) -> Column:
    found = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("."))
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def _amenities() -> Column:
    """All named amenities in order, each with its token and whether it is absent."""
    text = F.col("amenities")
    groups = F.when(text.startswith("["), F.from_json(text, _AMENITIES_SCHEMA))

    def describe(group: Column) -> Column:
        group_name = _stripped(F.lower(F.coalesce(group["group_name"], F.lit(""))))

        def one(item: Column) -> Column:
            value = F.coalesce(item["value"], F.lit(""))
            token = F.regexp_replace(F.lower(item["name"]), "[^a-z0-9]+", "_")
            return F.struct(
                F.btrim(token, F.lit("_")).alias("token"),
                item["name"].alias("name"),
                value.alias("value"),
                (
                    (group_name == NOT_INCLUDED_GROUP) | value.startswith("SYSTEM_NO_")
                ).alias("absent"),
            )

        named = F.filter(group["items"], lambda item: _stripped(item["name"]) != "")
        return F.coalesce(
            F.transform(named, one),
            F.array().cast(_AMENITY),
        )

    every = F.flatten(F.transform(groups, describe))
    return F.coalesce(
        every,
        F.array().cast(_AMENITY),
    )


def _until_limit(amenities: Column, limit: int | None) -> Column:
    """Amenities up to and including the ``limit``-th that is present; all without a limit.

    What is present decides the cut; absent ones are kept only before it.
    """
    if limit is None:
        return amenities
    positions = F.filter(
        F.transform(amenities, lambda a, i: F.when(~a["absent"], i + 1)),
        lambda i: i.isNotNull(),
    )
    last = F.get(positions, F.lit(limit - 1))
    return F.slice(amenities, F.lit(1), F.coalesce(last, F.size(amenities)))


def _amenity_text(amenity: Column) -> Column:
    value = amenity["value"]
    plain = value.startswith("SYSTEM_") | F.lower(value).isin("true", "1", "")
    return F.when(plain, amenity["name"]).otherwise(
        F.concat(amenity["name"], F.lit(": "), value)
    )


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def extract_listing_features(
    df: DataFrame, amenity_limit: int | None = None, text_item_limit: int | None = None
) -> DataFrame:
    """Eight columns read from ``description_items``, ``details`` and ``amenities``.

    Everything is read unless limits are given: ``amenity_limit`` amenities that are
    present, and ``text_item_limit`` items of each text list for the combined text.
    """
    staged = df.withColumns(
        {
            "desc_items": _items("description_items"),
            "detail_items": _items("details"),
            "amenity_items": _amenities(),
        }
    ).withColumn("amenity_items", _until_limit(F.col("amenity_items"), amenity_limit))

    desc, detail = F.col("desc_items"), F.col("detail_items")
    rest = F.lower(F.array_join(F.slice(desc, 2, 2**31 - 2), " | "))
    details = F.lower(F.array_join(detail, " | "))
    owned = F.filter("amenity_items", lambda a: ~a["absent"])
    lacking = F.filter("amenity_items", lambda a: a["absent"])

    def joined(tokens: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(tokens)), " | ")

    has_text = joined(F.transform(owned, lambda a: a["token"]))
    no_text = joined(F.transform(lacking, lambda a: F.concat(F.lit("no_"), a["token"])))
    parts = F.concat(
        _strings(_first(desc, text_item_limit)),
        _strings(_first(detail, text_item_limit)),
        F.transform(owned, _amenity_text),
    )
    blob = F.array_distinct(F.filter(parts, lambda part: F.length(part) > 2))
    bedrooms = F.when(details.rlike(STUDIO_PATTERN), F.lit(0.0)).otherwise(
        _first_number(details, BEDROOMS_PATTERN)
    )
    return (
        staged.withColumns(
            {
                "room_type_text": F.coalesce(
                    _stripped(F.lower(F.get(desc, F.lit(0)))), F.lit("")
                ),
                "n_beds": _first_number(rest, BEDS_PATTERN),
                "n_baths": _first_number(rest, BATHS_PATTERN),
                "n_bedrooms": bedrooms,
                "amenities_has_text": has_text,
                "amenities_no_text": no_text,
                "custom_text_blob": F.array_join(blob, ", "),
            }
        )
        .withColumn(
            "amenities_text",
            F.btrim(
                F.concat("amenities_has_text", F.lit(" | "), "amenities_no_text"),
                F.lit(" |"),
            ),
        )
        .drop("desc_items", "detail_items", "amenity_items")
    )


def _temperature(month: int) -> Column:
    return F.col("temperatures")[str(month)]["avg"]


def monthly_temperatures(df: DataFrame) -> DataFrame:
    """``temp_avg_m01`` to ``temp_avg_m12`` from the JSON map of months."""
    columns = {c: _temperature(i) for i, c in enumerate(TEMPERATURE_COLUMNS, start=1)}
    return (
        df.withColumn("temperatures", F.from_json("avg_temp_monthly", _TEMPERATURES_SCHEMA))
        .withColumns(columns)
        .drop("temperatures")
    )


def season_temperatures(df: DataFrame) -> DataFrame:
    """January and July, for the seasonality view."""
    return (
        df.withColumn("temperatures", F.from_json("avg_temp_monthly", _TEMPERATURES_SCHEMA))
        .withColumns({"temp_jan": _temperature(1), "temp_jul": _temperature(7)})
        .drop("temperatures")
    )


def neighbour_lists(neighbours: DataFrame, n: int) -> DataFrame:
    """Neighbours nested per source and target country, nearest first, at most ``n``.

    The cut comes before the grouping, so no list is longer than ``n``.
    """
    nearest = Window.partitionBy("src_property_id", "target_cc").orderBy(
        F.col("l2_dist").asc_nulls_last(), "neighbor_property_id"
    )
    keys = ["src_property_id", "target_cc"]
    rest = [c for c in neighbours.columns if c not in keys]
    kept = neighbours.withColumn("place", F.row_number().over(nearest)).where(
        F.col("place") <= n
    )
    ordered = F.sort_array(F.collect_list(F.struct("place", *rest)))
    return (
        kept.groupBy(*keys)
        .agg(ordered.alias("results"))
        .withColumn("results", F.transform("results", lambda r: r.dropFields("place")))
    )

