"""Cleaning, nested values, prices and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import view
from placerank.constants import (
    AMENITY_LIMIT,
    TEXT_ITEM_LIMIT,
    FINAL_COLUMNS,
    IMPUTED_COLUMNS,
    RATING_COLUMNS,
    RAW_COLUMNS,
    REQUIRED_COLUMNS,
    TEMPERATURE_COLUMNS,
)
from placerank.operators import cleaning, nested, pricing
from placerank.plans.offline import clean_listings

# --- SQL steps -----------------------------------------------------------------
_INTS = ["property_number_of_reviews", "host_number_of_reviews", "hosts_year", "guests"]
_DOUBLES = ["lat", "long", "ratings", "host_rating", "host_response_rate", "total_price"]


def _int(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]+$') THEN CAST({c} AS INTEGER) END AS {c}"


_KEPT = [
    c for c in RAW_COLUMNS if c not in _INTS + _DOUBLES + ["is_supperhost", "is_guest_favorite"]
]
TYPED = f"""SELECT {', '.join(_KEPT)},
  {', '.join(f'TRY_CAST({c} AS DOUBLE) AS {c}' for c in _DOUBLES)},
  {', '.join(_int(c) for c in _INTS)},
  CAST(is_supperhost = 'true' AS INTEGER) AS is_supperhost,
  CAST(is_guest_favorite = 'true' AS INTEGER) AS is_guest_favorite,
  CAST(availability = 'true' AS INTEGER) AS is_available
FROM raw_listings WHERE TRY_CAST(lat AS DOUBLE) IS NOT NULL AND TRY_CAST(long AS DOUBLE) IS NOT NULL"""

_MONEY = [
    "airbnb_service_fee", "cleaning_fee", "initial_price_per_night", "price_per_night",
    "price_without_fees", "special_offer", "taxes",
]
_OK_PRICING = "CASE WHEN json_valid(pricing_details) THEN pricing_details END"
PRICED = f"""SELECT * EXCLUDE (pricing_details),
  {', '.join(f"TRY_CAST(json_extract_string({_OK_PRICING}, '$.{c}') AS DOUBLE) AS {c}" for c in _MONEY)},
  TRY_CAST(json_extract_string({_OK_PRICING}, '$.num_of_nights') AS INTEGER) AS num_of_nights
FROM typed"""

_OK_RATINGS = "CASE WHEN json_valid(category_rating) THEN category_rating END"


def _rating(name: str, column: str) -> str:
    entries = f"""from_json({_OK_RATINGS}, '[{{"name":"VARCHAR","value":"VARCHAR"}}]')"""
    named = f"list_filter({entries}, lambda e: e.name = '{name}')"
    return f"TRY_CAST(list_extract({named}, -1).value AS DOUBLE) AS {column}"


RATED = f"""SELECT * EXCLUDE (category_rating),
  {', '.join(_rating(n, c) for n, c in RATING_COLUMNS.items())}
FROM priced"""

DEFAULTED = """SELECT * REPLACE (
  coalesce(property_number_of_reviews, 0) AS property_number_of_reviews,
  coalesce(host_number_of_reviews, 0) AS host_number_of_reviews,
  coalesce(is_supperhost, 0) AS is_supperhost, coalesce(is_available, 0) AS is_available,
  coalesce(cleaning_fee, 0) AS cleaning_fee, coalesce(airbnb_service_fee, 0) AS airbnb_service_fee,
  coalesce(num_of_nights, 1) AS num_of_nights, coalesce(taxes, 0) AS taxes,
  coalesce(special_offer, 0) AS special_offer)
FROM priced"""

DERIVED = """SELECT * REPLACE (
  CASE WHEN p < 0 THEN total_price ELSE round(p, 2) END AS price_per_night)
FROM (SELECT *, coalesce(price_per_night, initial_price_per_night,
    price_without_fees / nullif(num_of_nights, 0),
    (total_price - (airbnb_service_fee + cleaning_fee + taxes + special_offer)) / nullif(num_of_nights, 0),
    total_price / nullif(num_of_nights, 0)) AS p FROM defaulted)"""

CONVERTED = """SELECT * REPLACE (
  CASE WHEN currency = 'EUR' THEN round(price_per_night * 1.08e0, 2) ELSE round(price_per_night, 2) END
    AS price_per_night,
  CASE WHEN currency = 'EUR' THEN 'USD' ELSE currency END AS currency)
FROM derived"""

PRICE_STEPS = {
    "typed": TYPED, "priced": PRICED, "defaulted": DEFAULTED, "derived": DERIVED,
    "converted": CONVERTED,
}
_PRICE_VIEW = "SELECT property_id, currency, {} FROM {}"


# --- Spark stages -------------------------------------------------------------------
def typed(spark, folder):
    return cleaning.cast_types(cleaning.select_raw_columns(view(spark, folder, "raw_listings")))


def priced(spark, folder):
    return nested.parse_pricing(typed(spark, folder))


def defaulted(spark, folder):
    return cleaning.fill_defaults(priced(spark, folder))


def converted(spark, folder):
    return pricing.prices_to_usd(pricing.derive_nightly_price(defaulted(spark, folder)))


# --- queries --------------------------------------------------------------------------
_CAST_COLUMNS = ["property_id", *_DOUBLES, *_INTS, "is_supperhost", "is_guest_favorite", "is_available"]


@query("clean_cast", ["raw_listings"], f"SELECT {', '.join(_CAST_COLUMNS)} FROM typed", {"typed": TYPED})
def clean_cast(spark, folder):
    return typed(spark, folder).select(*_CAST_COLUMNS)


@query("raw_columns", ["raw_listings"], f"SELECT {', '.join(RAW_COLUMNS)} FROM raw_listings")
def raw_columns(spark, folder):
    return cleaning.select_raw_columns(view(spark, folder, "raw_listings"))


@query(
    "dedupe_first",
    ["orders"],
    """SELECT o_custkey AS property_id, o_orderkey, o_totalprice, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""",
)
def dedupe_first(spark, folder):
    snapshots = view(spark, folder, "orders").select(
        F.col("o_custkey").alias("property_id"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    return cleaning.one_per_key(snapshots, order_by=["o_totalprice", "o_orderkey"])


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED_COLUMNS)


@query(
    "critical_nulls", ["raw_listings"],
    f"""SELECT count(*) FILTER (WHERE {_COMPLETE}) AS kept,
  count(*) FILTER (WHERE NOT ({_COMPLETE})) AS dropped FROM typed""",
    {"typed": TYPED},
)
def critical_nulls(spark, folder):
    return cleaning.incomplete_count(typed(spark, folder))


@query(
    "complete_rows", ["raw_listings"],
    f"SELECT property_id, listing_name, ratings FROM typed WHERE {_COMPLETE}", {"typed": TYPED},
)
def complete_rows(spark, folder):
    return cleaning.drop_incomplete(typed(spark, folder)).select(
        "property_id", "listing_name", "ratings"
    )


_DEFAULT_COLUMNS = (
    "property_id, property_number_of_reviews, host_number_of_reviews, is_supperhost, is_available, "
    "cleaning_fee, airbnb_service_fee, num_of_nights, taxes, special_offer"
)


@query(
    "simple_defaults", ["raw_listings"], f"SELECT {_DEFAULT_COLUMNS} FROM defaulted",
    {"typed": TYPED, "priced": PRICED, "defaulted": DEFAULTED},
)
def simple_defaults(spark, folder):
    return defaulted(spark, folder).select(*_DEFAULT_COLUMNS.split(", "))


@query(
    "text_default", ["raw_listings"],
    """SELECT property_id, coalesce(description, listing_title, listing_name, 'No description provided')
  AS description FROM raw_listings""",
)
def text_default(spark, folder):
    filled = cleaning.fill_description(view(spark, folder, "raw_listings"))
    return filled.select("property_id", "description")


@query(
    "price_cap", ["listings"], "SELECT property_id, price_per_night FROM listings WHERE price_per_night <= 1000"
)
def price_cap(spark, folder):
    return cleaning.cap_price(view(spark, folder, "listings")).select("property_id", "price_per_night")


_LOGS = ["log_1p_price_per_night", "log_1p_property_number_of_reviews", "log_1p_host_number_of_reviews"]


@query(
    "log1p_cols", ["listings"],
    "SELECT property_id, "
    + ", ".join(f"round(ln(1 + {c.removeprefix('log_1p_')}), 6) AS {c}" for c in _LOGS)
    + " FROM listings",
)
def log1p_cols(spark, folder):
    return rounded(cleaning.add_logs(view(spark, folder, "listings")).select("property_id", *_LOGS), *_LOGS)


@query(
    "pricing_json", ["raw_listings"],
    f"SELECT property_id, {', '.join(_MONEY)}, num_of_nights FROM priced", {"typed": TYPED, "priced": PRICED},
)
def pricing_json(spark, folder):
    return priced(spark, folder).select("property_id", *_MONEY, "num_of_nights")


@query(
    "rating_map", ["raw_listings"], f"SELECT property_id, {', '.join(RATING_COLUMNS.values())} FROM rated",
    {"typed": TYPED, "priced": PRICED, "rated": RATED},
)
def rating_map(spark, folder):
    return nested.parse_ratings(typed(spark, folder)).select("property_id", *RATING_COLUMNS.values())


@query(
    "price_waterfall", ["raw_listings"],
    "SELECT property_id, round(price_per_night, 6) AS price_per_night FROM derived", PRICE_STEPS,
)
def price_waterfall(spark, folder):
    derived = pricing.derive_nightly_price(defaulted(spark, folder))
    return rounded(derived.select("property_id", "price_per_night"), "price_per_night")


@query(
    "currency_usd", ["raw_listings"],
    "SELECT property_id, currency, round(price_per_night, 6) AS price_per_night FROM converted", PRICE_STEPS,
)
def currency_usd(spark, folder):
    return rounded(
        converted(spark, folder).select("property_id", "currency", "price_per_night"), "price_per_night"
    )


# Means of tenths often end in a half; as decimals they are rounded half up,
# whatever the order in which the doubles were summed.
_AVERAGES = ", ".join(
    f"CAST(round(CAST(avg({c}) AS DECIMAL(28, 12)), 2) AS DOUBLE) AS avg_{c}" for c in IMPUTED_COLUMNS
)


@query(
    "imputation_means", ["listings"],
    f"""SELECT addr_cc, CAST(grouping(addr_cc) AS INTEGER) AS is_overall, {_AVERAGES}
FROM listings GROUP BY GROUPING SETS ((addr_cc), ())""",
)
def imputation_means(spark, folder):
    return pricing.imputation_means(view(spark, folder, "listings"))


@query(
    "impute_country", ["listings"],
    "SELECT property_id, addr_cc, "
    + ", ".join(
        f"coalesce({c}, avg_{c}, (SELECT avg_{c} FROM overall)) AS {c}" for c in IMPUTED_COLUMNS
    )
    + " FROM listings LEFT JOIN means USING (addr_cc)",
    {
        "means": f"SELECT addr_cc, {_AVERAGES} FROM listings GROUP BY addr_cc",
        "overall": f"SELECT {_AVERAGES} FROM listings",
    },
)
def impute_country(spark, folder):
    filled = pricing.impute(view(spark, folder, "listings"))
    return filled.select("property_id", "addr_cc", *IMPUTED_COLUMNS)


@query(
    "month_temps", ["cities"],
    "SELECT addr_cc, addr_name, "
    + ", ".join(
        f"CAST(json_extract_string(avg_temp_monthly, '$.\"{m}\".avg') AS DOUBLE) AS temp_avg_m{m:02d}"
        for m in range(1, 13)
    )
    + " FROM cities",
)
def month_temps(spark, folder):
    return nested.monthly_temperatures(view(spark, folder, "cities")).select(
        "addr_cc", "addr_name", *TEMPERATURE_COLUMNS
    )


@query(
    "season_temps", ["cities"],
    """SELECT addr_cc, addr_name, budget_level,
  CAST(json_extract_string(avg_temp_monthly, '$."1".avg') AS DOUBLE) AS temp_jan,
  CAST(json_extract_string(avg_temp_monthly, '$."7".avg') AS DOUBLE) AS temp_jul FROM cities""",
)
def season_temps(spark, folder):
    return nested.season_temperatures(view(spark, folder, "cities")).select(
        "addr_cc", "addr_name", "budget_level", "temp_jan", "temp_jul"
    )


# The SQL twin of the listing features walks the same JSON with list functions.
_AMENITY_STEPS = {
    "parsed": """SELECT property_id,
  coalesce(CASE WHEN json_valid(description_items) THEN CAST(description_items::JSON AS VARCHAR[]) END, []) AS d,
  coalesce(CASE WHEN json_valid(details) THEN CAST(details::JSON AS VARCHAR[]) END, []) AS t,
  CASE WHEN json_valid(amenities) THEN from_json(amenities,
    '[{"group_name":"VARCHAR","items":[{"name":"VARCHAR","value":"VARCHAR"}]}]') END AS g
FROM raw_listings""",
    "grouped": """SELECT property_id, gi, lower(trim(x.group_name)) = 'not included' AS excluded, x.items AS items
FROM (SELECT property_id, unnest(g) AS x, generate_subscripts(g, 1) AS gi FROM parsed WHERE g IS NOT NULL)""",
    "items": """SELECT property_id, gi, ii, excluded OR starts_with(v, 'SYSTEM_NO_') AS absent, name, v
FROM (SELECT property_id, gi, ii, excluded, i.name AS name, coalesce(i.value, '') AS v
  FROM (SELECT property_id, gi, excluded, unnest(items) AS i, generate_subscripts(items, 1) AS ii FROM grouped))
WHERE trim(name) <> ''""",
    "counted": """SELECT *, coalesce(count(*) FILTER (WHERE NOT absent) OVER
    (PARTITION BY property_id ORDER BY gi, ii ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS token
FROM items""",
    "tokens": """SELECT property_id,
  coalesce(array_to_string(list_sort(list_distinct(list(token) FILTER (WHERE NOT absent))), ' | '), '') AS has_text,
  coalesce(array_to_string(list_sort(list_distinct(list('no_' || token) FILTER (WHERE absent))), ' | '), '') AS no_text,
  list(CASE WHEN starts_with(v, 'SYSTEM_') OR lower(v) IN ('true', '1', '') THEN name ELSE name || ': ' || v END
    ORDER BY gi, ii) FILTER (WHERE NOT absent) AS shown
FROM counted WHERE before < 40 GROUP BY property_id""",
    "parts": """SELECT property_id, any_value(x) AS x, min(p) AS p FROM (
  SELECT property_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (
    SELECT property_id, list_concat(list_concat(list_slice(d, 1, 10), list_slice(t, 1, 10)),
      coalesce(shown, [])) AS l FROM parsed LEFT JOIN tokens USING (property_id)))
WHERE length(x) > 2 GROUP BY property_id, x""",
    "blobs": "SELECT property_id, string_agg(x, ', ' ORDER BY p) AS blob FROM parts GROUP BY property_id",
}
_REST = "lower(array_to_string(list_slice(d, 2, 1000000), ' | '))"
_DETAIL = "lower(array_to_string(t, ' | '))"


def _number(text: str, words: str) -> str:
    found = f"regexp_extract({text}, '([0-9]+(?:[.,][0-9]+)?)\\s*(?:{words})\\b', 1)"
    return f"coalesce(TRY_CAST(replace({found}, ',', '.') AS DOUBLE), 0)"


_FEATURES = [
    "room_type_text", "n_beds", "n_baths", "n_bedrooms", "amenities_has_text",
    "amenities_no_text", "amenities_text", "custom_text_blob",
]


@query(
    "listing_features", ["raw_listings"],
    f"""SELECT property_id, coalesce(trim(lower(d[1])), '') AS room_type_text,
  {_number(_REST, 'bed|beds|betten')} AS n_beds,
  {_number(_REST, 'bath|baths|bathroom|bathrooms|badezimmer|bäder|baeder')} AS n_baths,
  CASE WHEN regexp_matches({_DETAIL}, '\\bstudio\\b') THEN 0
    ELSE {_number(_DETAIL, 'bedroom|bedrooms|schlafzimmer')} END AS n_bedrooms,
  coalesce(has_text, '') AS amenities_has_text, coalesce(no_text, '') AS amenities_no_text,
  trim(coalesce(has_text, '') || ' | ' || coalesce(no_text, ''), ' |') AS amenities_text,
  coalesce(blob, '') AS custom_text_blob
FROM parsed LEFT JOIN tokens USING (property_id) LEFT JOIN blobs USING (property_id)""",
    _AMENITY_STEPS,
)
def listing_features(spark, folder):
    raw = view(spark, folder, "raw_listings")
    return nested.extract_listing_features(raw, AMENITY_LIMIT, TEXT_ITEM_LIMIT).select("property_id", *_FEATURES)


_NEAR = """SELECT property_id, first(name ORDER BY dist, name, cc) AS addr_name,
  first(cc ORDER BY dist, name, cc) AS addr_cc, first(admin1 ORDER BY dist, name, cc) AS addr_admin1
FROM (SELECT t.property_id, g.*, round(2 * 6371000 * asin(least(1, sqrt(
    power(sin(radians(g.lat - t.lat) / 2), 2)
    + cos(radians(t.lat)) * cos(radians(g.lat)) * power(sin(radians(g.lon - t.long) / 2), 2)))), 3) AS dist
  FROM typed t CROSS JOIN gazetteer g) GROUP BY property_id"""
_SHOWN = [
    "property_id", "listing_title", "addr_name", "addr_cc", "addr_admin1", "ratings",
    "price_per_night", "host_rating", "hosts_year", "rating_value", "description", "is_available",
    "log_1p_price_per_night", "log_1p_host_number_of_reviews",
]
_CLEAN_STEPS = {
    "typed": TYPED, "near": _NEAR, "priced": PRICED,
    "rated": RATED,
    "complete": f"SELECT * FROM rated JOIN near USING (property_id) WHERE {_COMPLETE}",
    "defaulted": DEFAULTED.replace("FROM priced", "FROM complete"),
    "derived": DERIVED, "converted": CONVERTED,
    "means": f"SELECT addr_cc, {_AVERAGES} FROM converted GROUP BY addr_cc",
    "overall": f"SELECT {_AVERAGES} FROM converted",
    "imputed": "SELECT * REPLACE ("
    + ", ".join(
        f"coalesce({c}, avg_{c}, (SELECT avg_{c} FROM overall)) AS {c}" for c in IMPUTED_COLUMNS
    )
    + ") FROM converted LEFT JOIN means USING (addr_cc)",
    "final": """SELECT * REPLACE (coalesce(description, listing_title, listing_name) AS description),
  round(ln(1 + price_per_night), 6) AS log_1p_price_per_night,
  round(ln(1 + host_number_of_reviews), 6) AS log_1p_host_number_of_reviews
FROM imputed WHERE price_per_night <= 1300""",
}


@query(
    "clean_pipeline", ["raw_listings", "gazetteer"], f"SELECT {', '.join(_SHOWN)} FROM final", _CLEAN_STEPS
)
def clean_pipeline(spark, folder):
    cleaned = clean_listings(view(spark, folder, "raw_listings"), view(spark, folder, "gazetteer"))
    assert cleaned.columns[: len(FINAL_COLUMNS)] == FINAL_COLUMNS
    return rounded(cleaned.select(*_SHOWN), "log_1p_price_per_night", "log_1p_host_number_of_reviews")
