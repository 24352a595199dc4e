"""The given tables projected to the model, as SQL that Spark and DuckDB both read.

Numbers are written with an exponent so that both engines take them as doubles,
and text is built from whole numbers so that both spell it alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["customer", "orders", "nation", "region", "events", "documents", "embeddings"]
CODES = (
    "FR IT ES GB DE NL PT GR HR AT CH BE SE NO DK FI PL CZ HU IE IS MT GI JE AX"
).split()
_CODES = ",".join(CODES)
GROUPS = (
    "culture,family,food,health,leisure,nature,nightlife,services,shopping,"
    "sightseeing,supplies,transport"
)
# Tags to build elements from; some of them are no point of interest.
_AMENITY = (
    "restaurant,cafe,bar,theatre,place_of_worship,bank,pharmacy,taxi,bench,parking"
)
_OTHER = (
    "tourism=museum,tourism=attraction,leisure=park,leisure=stadium,shop=bakery,"
    "shop=mall,railway=station,building=yes,historic=ruins,leisure=playground,note=x"
)


def _code(index: str) -> str:
    return f"split_part('{_CODES}', ',', CAST({index} AS INT) + 1)"


def _tenths(number: str) -> str:
    whole = f"CAST(CAST(floor(({number}) / 1e1) AS BIGINT) AS STRING)"
    return f"{whole} || '.' || CAST(({number}) % 10 AS STRING)"


def _text(number: str) -> str:
    return f"CAST({number} AS STRING)"


_RATING_STEPS = {
    "rating_cleanliness": 2, "rating_accuracy": 5, "rating_checkin": 8,
    "rating_communication": 13, "rating_location": 16, "rating_value": 19,
}
_RATING_NAMES = {
    "Cleanliness": 2, "Accuracy": 5, "Check-in": 8, "Communication": 13,
    "Location": 16, "Value": 19,
}
_RATINGS = ",\n  ".join(
    f"3 + (c_custkey * {m} % 21) / 1e1 AS {name}" for name, m in _RATING_STEPS.items()
)
_LAT = "40e0 + c_nationkey * 5e-1 + (c_custkey % 4) * 1e-1 + ((c_custkey * 31) % 41 - 20) / 1e3"
_LONG = "c_nationkey * 7e-1 + (c_custkey % 4) * 1e-1 + ((c_custkey * 17) % 43 - 21) / 1e3"

_RATING_JSON = " || ',' || ".join(
    f"'{{\"name\": \"{name}\", \"value\": \"' || {_tenths(f'30 + c_custkey * {m} % 21')} || '\"}}'"
    for name, m in _RATING_NAMES.items()
)
_REPEATED = "',{\"name\": \"Value\", \"value\": \"1.5\"}'"
_MANY = ",".join(f'{{"name": "Extra Item {i}", "value": "true"}}' for i in range(45))
_AMENITY_JSON = (
    "'[{\"group_name\": \"Basics\", \"items\": ["
    "{\"name\": \"Wi-Fi\", \"value\": \"SYSTEM_WI_FI\"},"
    "{\"name\": \"TV\", \"value\": \"' || CAST(30 + c_custkey % 30 AS STRING) || '-inch\"},"
    "{\"name\": \"  \", \"value\": \"\"},"
    "{\"name\": \"Pool\", \"value\": \"' || CASE WHEN c_custkey % 3 = 0 "
    "THEN 'SYSTEM_NO_POOL' ELSE 'true' END || '\"}]},'"
    " || CASE WHEN c_custkey % 11 = 0 THEN "
    "'{\"group_name\": \"Many\", \"items\": [" + _MANY + "]},' ELSE '' END || "
    "'{\"group_name\": \"Not included\", \"items\": ["
    "{\"name\": \"Smoke alarm\", \"value\": \"\"}, {\"name\": \"Heating\", \"value\": \"\"}]}]'"
)

VIEWS: dict[str, tuple[list[str], str]] = {
    "order_counts": (
        ["orders"],
        "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey",
    ),
    "listings": (
        ["customer", "order_counts"],
        f"""SELECT c_custkey AS property_id, c_name AS listing_title,
  lower(c_mktsegment) AS room_type_text,
  {_code('c_nationkey')} AS addr_cc, 'CITY_' || CAST(c_custkey % 4 AS STRING) AS addr_name,
  {_LAT} AS lat,
  {_LONG} AS long,
  CASE WHEN c_acctbal >= 0 THEN round(c_acctbal / 7e0, 2) END AS price_per_night,
  CAST(1 + c_custkey % 6 AS INT) AS guests, 3 + (c_custkey * 37 % 21) / 1e1 AS ratings,
  coalesce(n_orders, 0) AS property_number_of_reviews,
  CASE WHEN c_custkey % 10 <> 0 THEN 3 + (c_custkey * 11 % 21) / 1e1 END AS host_rating,
  (c_custkey * 53) % 200 AS host_number_of_reviews,
  CAST((c_custkey * 7) % 101 AS DOUBLE) AS host_response_rate,
  CAST(c_custkey % 12 AS DOUBLE) AS hosts_year,
  {_RATINGS},
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_supperhost,
  CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS is_guest_favorite,
  'listing/' || CAST(c_custkey AS STRING) AS final_url
FROM customer LEFT JOIN order_counts ON c_custkey = o_custkey""",
    ),
    "raw_listings": (
        ["customer", "order_counts"],
        f"""SELECT CAST(c_custkey AS STRING) AS property_id,
  CASE WHEN c_custkey % 50 <> 7 THEN 'Name ' || CAST(c_custkey AS STRING) END AS listing_name,
  CASE WHEN c_custkey % 97 <> 5 THEN c_name END AS listing_title,
  CASE WHEN c_custkey % 61 = 3 THEN NULL WHEN c_custkey % 61 = 4 THEN 'north'
    ELSE CAST(40 + c_nationkey AS STRING) || '.' || CAST(100 + c_custkey % 900 AS STRING) END AS lat,
  CAST(c_nationkey AS STRING) || '.' || CAST(100 + c_custkey * 7 % 900 AS STRING) AS long,
  CASE WHEN c_custkey % 43 = 1 THEN 'n/a' ELSE {_tenths('30 + c_custkey * 37 % 21')} END AS ratings,
  '[]' AS reviews,
  CAST(n_orders AS STRING) AS property_number_of_reviews,
  CASE WHEN c_custkey % 10 <> 0 THEN {_tenths('30 + c_custkey * 11 % 21')} END AS host_rating,
  CAST((c_custkey * 53) % 200 AS STRING) AS host_number_of_reviews,
  CASE WHEN c_custkey % 8 <> 0 THEN CAST((c_custkey * 7) % 101 AS STRING) END AS host_response_rate,
  CASE WHEN c_custkey % 37 = 0 THEN '4.7' ELSE CAST(c_custkey % 12 AS STRING) END AS hosts_year,
  CASE WHEN c_custkey % 3 = 0 THEN 'true' WHEN c_custkey % 3 = 1 THEN 'True' END AS is_supperhost,
  CASE WHEN c_custkey % 71 <> 9 THEN CASE WHEN c_custkey % 4 = 1 THEN 'true' ELSE 'false' END END
    AS is_guest_favorite,
  CASE WHEN c_custkey % 53 <> 2 THEN CAST(c_custkey % 6 AS STRING) END AS guests,
  lower(c_mktsegment) AS category,
  CASE WHEN c_custkey % 23 = 0 THEN '[{{"broken' ELSE '[' || {_RATING_JSON}
    || CASE WHEN c_custkey % 19 = 0 THEN {_REPEATED} ELSE '' END || ']' END AS category_rating,
  CASE WHEN c_custkey % 29 = 0 THEN '[{{"broken' ELSE {_AMENITY_JSON} END AS amenities,
  CASE WHEN c_custkey % 5 <> 0 THEN 'A place of ' || lower(c_mktsegment) END AS description,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE '["  Entire ' || c_mktsegment || ' ", "'
    || CAST(1 + c_custkey % 5 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ' Beds' ELSE ' betten' END
    || '", "' || CASE WHEN c_custkey % 4 = 0 THEN '1,5 bäder' ELSE CAST(c_custkey % 3 AS STRING)
    || ' baths' END || '", ""]' END AS description_items,
  '["' || CASE WHEN c_custkey % 9 = 0 THEN 'Studio' ELSE 'Flat' END || '", "'
    || CAST(c_custkey % 5 AS STRING) || ' bedrooms", "ok"]' AS details,
  CASE WHEN c_custkey % 47 = 0 THEN 'broken' ELSE
    '{{"cleaning_fee": ' || CAST(c_custkey % 50 AS STRING)
    || CASE WHEN c_custkey % 2 = 0 THEN ', "num_of_nights": ' || CAST(c_custkey % 7 AS STRING) ELSE '' END
    || CASE WHEN c_custkey % 3 = 0 THEN ', "price_per_night": ' || {_tenths('c_custkey * 13 % 9000')} ELSE '' END
    || CASE WHEN c_custkey % 5 = 0 THEN ', "initial_price_per_night": ' || CAST(c_custkey % 400 AS STRING) ELSE '' END
    || CASE WHEN c_custkey % 7 = 0 THEN ', "price_without_fees": ' || CAST(c_custkey % 900 AS STRING) ELSE '' END
    || ', "special_offer": -' || CAST(c_custkey % 20 AS STRING)
    || ', "taxes": ' || CAST(c_custkey * 3 % 800 AS STRING) || '}}' END AS pricing_details,
  CASE WHEN c_custkey % 13 <> 0 THEN {_tenths('c_custkey * 29 % 15000')} END AS total_price,
  CASE c_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN NULL ELSE 'EUR' END AS currency,
  CASE WHEN c_custkey % 6 = 0 THEN 'false' ELSE 'true' END AS availability,
  'listing/' || CAST(c_custkey AS STRING) AS final_url
FROM customer LEFT JOIN order_counts ON c_custkey = o_custkey""",
    ),
    "placed_events": (
        ["events"],
        """SELECT *, event_id % 25 AS nation_i, CAST(floor(event_id / 25e0) AS BIGINT) % 4 AS city
FROM events""",
    ),
    "pois": (
        ["placed_events"],
        f"""SELECT event_id AS osm_id, {_code('nation_i')} AS addr_cc,
  40e0 + nation_i * 5e-1 + city * 1e-1 + ((event_id * 13) % 37 - 18) / 1e3 AS lat,
  nation_i * 7e-1 + city * 1e-1 + ((event_id * 29) % 47 - 23) / 1e3 AS lon,
  split_part('{GROUPS}', ',', CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12 + 1) AS poi_group
FROM placed_events""",
    ),
    "elements": (
        ["events"],
        f"""SELECT event_id AS osm_id,
  CASE event_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
  split_part('{_AMENITY}', ',', CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 + 1) AS amenity,
  split_part('{_OTHER}', ',', CAST((event_id * 7) % 11 AS INT) + 1) AS other
FROM events""",
    ),
    "city_cells": (
        ["nation"],
        " UNION ALL ".join(
            f"SELECT n_nationkey, n_name, n_regionkey, {i} AS city FROM nation" for i in range(4)
        ),
    ),
    "cities": (
        ["city_cells"],
        f"""SELECT {_code('n_nationkey')} AS addr_cc, 'CITY_' || CAST(city AS STRING) AS addr_name,
  n_name AS addr_admin1, CAST(NULL AS STRING) AS addr_admin2,
  40e0 + n_nationkey * 5e-1 + city * 1e-1 AS latitude, n_nationkey * 7e-1 + city * 1e-1 AS longitude,
  CASE (n_nationkey + city) % 3 WHEN 0 THEN 'Budget' WHEN 1 THEN 'Mid-range' ELSE 'Luxury' END
    AS budget_level,
  '{{' || """
        + " || ',' || ".join(
            f"'\"{m}\":{{\"avg\":' || CAST(10 + (n_nationkey + {m} * 3 + city) % 25 AS STRING)"
            f" || ',\"max\":40,\"min\":-5}}'"
            for m in range(1, 13)
        )
        + """ || '}' AS avg_temp_monthly
FROM city_cells WHERE (n_nationkey + city * 7) % 9 <> 0""",
    ),
    "gazetteer": (
        ["city_cells", "region"],
        f"""SELECT 'CITY_' || CAST(city AS STRING) AS name, {_code('n_nationkey')} AS cc,
  r_name AS admin1, n_name AS admin2,
  40e0 + n_nationkey * 5e-1 + city * 1e-1 AS lat, n_nationkey * 7e-1 + city * 1e-1 AS lon
FROM city_cells JOIN region ON n_regionkey = r_regionkey""",
    ),
    "continents": (
        ["nation", "region"],
        f"""SELECT lower(r_name) AS continent, {_code('n_nationkey')} AS addr_cc, r_regionkey AS position
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT lower(r_name) AS continent, {_code('n_nationkey')} AS addr_cc, r_regionkey AS position
FROM nation JOIN region ON (n_regionkey + 2) % 5 = r_regionkey WHERE n_nationkey % 4 = 0""",
    ),
    "text_listings": (
        ["documents"],
        """SELECT doc_id AS property_id, text AS text_all, source AS addr_name,
  CASE lang WHEN 'en' THEN 'GB' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' ELSE 'ES' END AS addr_cc
FROM documents""",
    ),
    "vectors": (
        ["embeddings"],
        f"""SELECT vec_id AS property_id, {_code('label')} AS addr_cc,
  CAST(embedding AS {{doubles}}) AS features_norm
FROM embeddings""",
    ),
}


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name in VIEWS and name not in seen:
            _closure(VIEWS[name][0], seen)
            seen.append(name)
    return seen


def with_views(names: list[str], select: str, more: dict[str, str] | None = None) -> str:
    """DuckDB SQL: the views needed, any further steps, and the final query."""
    steps = [
        f"{name} AS ({VIEWS[name][1].replace('{doubles}', 'DOUBLE[]')})"
        for name in _closure(names, [])
    ]
    steps += [f"{name} AS ({body})" for name, body in (more or {}).items()]
    return f"WITH {', '.join(steps)} {select}" if steps else select


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One view over the Parquet files of a folder."""
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    needed = _closure([name], [])
    tables = {t for n in needed for t in VIEWS[n][0] if t in TABLES}
    steps = [f"{t} AS (SELECT * FROM parquet.`{folder}/{t}.parquet`)" for t in sorted(tables)]
    steps += [f"{n} AS ({VIEWS[n][1].replace('{doubles}', 'ARRAY<DOUBLE>')})" for n in needed]
    return spark.sql(f"WITH {', '.join(steps)} SELECT * FROM {name}")
