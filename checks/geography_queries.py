"""Surroundings, places, classes and cities."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import view
from placerank.constants import ENV_COLUMNS, ENV_GROUPS, GROUP_PRIORITY, POI_CLASSES
from placerank.operators import geography
from placerank.plans.offline import integrate

_HAVERSINE = """2 * 6371000 * asin(sqrt(power(sin(radians(p.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - a.long) / 2), 2)))"""
_PAIRS = f"""SELECT a.property_id, p.poi_group FROM listings a JOIN pois p ON {{key}}
  p.lat BETWEEN a.lat - 1000 / 111000e0 AND a.lat + 1000 / 111000e0
  AND p.lon BETWEEN a.long - 1000 / (111000e0 * cos(radians(a.lat)))
    AND a.long + 1000 / (111000e0 * cos(radians(a.lat)))
WHERE {_HAVERSINE} <= 1000"""
PAIRS = _PAIRS.format(key="a.addr_cc = p.addr_cc AND")
_WIDE = ", ".join(
    f"CAST(count(*) FILTER (WHERE poi_group = '{g}') AS INTEGER) AS env_{g}" for g in ENV_GROUPS
)
ENVIRONMENT = f"""SELECT property_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ENV_COLUMNS)}
FROM listings LEFT JOIN (SELECT property_id, {_WIDE} FROM pairs GROUP BY property_id) USING (property_id)"""


@query("poi_groups", ["pois"], "SELECT addr_cc, lat AS p_lat, lon AS p_lon, poi_group FROM pois")
def poi_groups(spark, folder):
    loud = view(spark, folder, "pois").withColumn(
        "poi_group", F.concat(F.lit(" "), F.initcap("poi_group"), F.lit(" "))
    )
    return geography.clean_poi_groups(loud)


@query(
    "env_counts", ["listings", "pois"],
    "SELECT property_id, poi_group, CAST(count(*) AS INTEGER) AS n_places FROM pairs GROUP BY 1, 2",
    {"pairs": PAIRS},
)
def env_counts(spark, folder):
    return geography.count_nearby_long(view(spark, folder, "listings"), view(spark, folder, "pois"))


@query("env_wide", ["listings", "pois"], "SELECT * FROM env", {"pairs": PAIRS, "env": ENVIRONMENT})
def env_wide(spark, folder):
    wide = geography.attach_environment(view(spark, folder, "listings"), view(spark, folder, "pois"))
    return wide.select("property_id", *ENV_COLUMNS)


@query(
    "env_cross_border", ["listings", "pois"], "SELECT * FROM env",
    {"pairs": _PAIRS.format(key=""), "env": ENVIRONMENT},
)
def env_cross_border(spark, folder):
    wide = geography.attach_environment(
        view(spark, folder, "listings"), view(spark, folder, "pois"), cross_border=True
    )
    return wide.select("property_id", *ENV_COLUMNS)


@query(
    "env_schema", ["listings"],
    f"SELECT property_id, {', '.join(f'0 AS {c}' for c in ENV_COLUMNS)} FROM listings",
)
def env_schema(spark, folder):
    bare = view(spark, folder, "listings").select("property_id")
    return geography.complete_environment(bare)


_CITY_FACTS = ["city_addr_admin1", "latitude", "longitude", "budget_level", "avg_temp_monthly"]
CITY_JOIN = """SELECT l.*, c.addr_admin1 AS city_addr_admin1, c.latitude, c.longitude, c.budget_level,
  c.avg_temp_monthly FROM listings l LEFT JOIN cities c ON l.addr_cc = c.addr_cc AND l.addr_name = c.addr_name"""


@query(
    "city_join", ["listings", "cities"],
    f"SELECT property_id, addr_cc, addr_name, {', '.join(_CITY_FACTS)} FROM ({CITY_JOIN})",
)
def city_join(spark, folder):
    joined = geography.join_cities(view(spark, folder, "listings"), view(spark, folder, "cities"))
    return joined.select("property_id", "addr_cc", "addr_name", *_CITY_FACTS)


@query(
    "europe_join", ["listings", "cities", "pois"],
    "SELECT property_id, addr_cc, budget_level, "
    f"{', '.join(ENV_COLUMNS)} FROM ({CITY_JOIN}) JOIN env USING (property_id)",
    {"pairs": PAIRS, "env": ENVIRONMENT},
)
def europe_join(spark, folder):
    joined = integrate(
        view(spark, folder, "listings"), view(spark, folder, "cities"), view(spark, folder, "pois")
    )
    return joined.select("property_id", "addr_cc", "budget_level", *ENV_COLUMNS)


def _nearest_sql(table: str, key: str, lon: str) -> str:
    names = {"addr_name": "name", "addr_cc": "cc", "addr_admin1": "admin1", "addr_admin2": "admin2"}
    best = ", ".join(f"arg_min(g.{v}, d) AS {k}" for k, v in names.items())
    return f"""SELECT {key}, {best} FROM (SELECT t.{key}, g, struct_pack(d := round(2 * 6371000 * asin(least(1, sqrt(
    power(sin(radians(g.lat - t.lat) / 2), 2)
    + cos(radians(t.lat)) * cos(radians(g.lat)) * power(sin(radians(g.lon - t.{lon}) / 2), 2)))), 3),
    n := g.name, c := g.cc) AS d FROM {table} t CROSS JOIN gazetteer g) GROUP BY {key}"""


@query("nearest_place", ["listings", "gazetteer"], _nearest_sql("listings", "property_id", "long"))
def nearest_place(spark, folder):
    bare = view(spark, folder, "listings").select("property_id", "lat", "long")
    return geography.nearest_place(bare, view(spark, folder, "gazetteer")).drop("lat", "long")


@query("poi_places", ["pois", "gazetteer"], _nearest_sql("pois", "osm_id", "lon"))
def poi_places(spark, folder):
    bare = view(spark, folder, "pois").select("osm_id", "lat", "lon")
    return geography.nearest_place(bare, view(spark, folder, "gazetteer"), lon="lon").drop("lat", "lon")


@query(
    "city_places", ["cities", "gazetteer"],
    "SELECT addr_cc AS known_cc, addr_name AS known_name, addr_cc, addr_name FROM cities",
)
def city_places(spark, folder):
    cities = view(spark, folder, "cities").select(
        F.col("addr_cc").alias("known_cc"), F.col("addr_name").alias("known_name"),
        "latitude", "longitude",
    )
    found = geography.nearest_place(
        cities, view(spark, folder, "gazetteer"), lat="latitude", lon="longitude"
    )
    return found.select("known_cc", "known_name", "addr_cc", "addr_name")


_MAPPING = ", ".join(
    f"('{k}={v}', '{c}', '{g}', {GROUP_PRIORITY[g]})" for (k, v), (c, g) in POI_CLASSES.items()
)


def _elements(spark, folder):
    other = F.split("other", "=")
    tags = F.create_map(F.lit("amenity"), F.col("amenity"), other[0], other[1])
    return view(spark, folder, "elements").withColumn("tags", tags)


@query(
    "classify_poi", ["elements"],
    f"""SELECT osm_id, osm_type, poi_class, poi_group FROM (
  SELECT osm_id, osm_type, 1 AS pos, 'amenity=' || amenity AS tag FROM elements
  UNION ALL SELECT osm_id, osm_type, 2 AS pos, other AS tag FROM elements)
JOIN (VALUES {_MAPPING}) m(tag, poi_class, poi_group, priority) USING (tag)
QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY priority, pos) = 1""",
)
def classify_poi(spark, folder):
    found = geography.classify_pois(_elements(spark, folder))
    return found.select("osm_id", "osm_type", "poi_class", "poi_group")


@query("poi_sample", ["elements"], "SELECT osm_id, osm_type FROM elements WHERE osm_id % 10 = 0")
def poi_sample(spark, folder):
    return geography.sample_elements(view(spark, folder, "elements")).select("osm_id", "osm_type")


@query(
    "poi_sample_capped", ["elements"],
    "SELECT osm_id, osm_type FROM elements WHERE osm_id % 10 = 0 ORDER BY osm_id LIMIT 50",
)
def poi_sample_capped(spark, folder):
    return geography.sample_elements(view(spark, folder, "elements"), max_rows=50).select(
        "osm_id", "osm_type"
    )


@query(
    "poi_kinds", ["elements"],
    "SELECT osm_id, osm_type FROM elements WHERE osm_type IN ('way', 'relation')",
)
def poi_kinds(spark, folder):
    return geography.keep_kinds(view(spark, folder, "elements"), ["way", "relation"]).select(
        "osm_id", "osm_type"
    )
