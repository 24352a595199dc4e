"""Browsing, profiling and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import view
from placerank.constants import (
    BROWSE_LIMIT,
    CANONICAL_CONTINENTS,
    CONTINENT_TITLES,
    ENV_GROUPS,
    PICKER_COLUMNS,
)
from placerank.functions.expressions import truncated
from placerank.operators import browsing, coverage, profile_state, profiling
from placerank.sources.scratch import scratch_path

_PICKER = ", ".join(PICKER_COLUMNS)


# --- browsing -------------------------------------------------------------------------
@query(
    "browse_filter", ["listings"],
    f"""SELECT {_PICKER} FROM listings WHERE addr_cc = 'FR' AND ratings BETWEEN 3.5 AND 5
  AND price_per_night BETWEEN 50 AND 900
ORDER BY ratings DESC, price_per_night, property_id LIMIT 300""",
)
def browse_filter(spark, folder):
    return browsing.browse(
        view(spark, folder, "listings"), BROWSE_LIMIT, country=" fr ", rating=(3.5, 5), price=(50, 900)
    )


@query(
    "browse_open", ["listings"],
    """SELECT property_id, price_per_night FROM listings WHERE addr_name = 'CITY_1' AND price_per_night >= 100""",
)
def browse_open(spark, folder):
    kept = browsing.filter_listings(view(spark, folder, "listings"), city="CITY_1", price=(100, None))
    return kept.select("property_id", "price_per_night")


@query(
    "browse_search", ["listings"],
    """SELECT property_id FROM listings WHERE contains(lower(concat_ws(' ', coalesce(listing_title, ''),
  coalesce(room_type_text, ''), coalesce(addr_name, ''), coalesce(addr_cc, ''),
  coalesce(CAST(price_per_night AS STRING), ''), coalesce(CAST(ratings AS STRING), ''))), 'city_1 de ')""",
)
def browse_search(spark, folder):
    """The end of a city and its country: text that runs over two of the six columns."""
    return browsing.search(view(spark, folder, "listings"), "CITY_1 de ").select("property_id")


@query("country_choices", ["listings"], "SELECT DISTINCT addr_cc FROM listings")
def country_choices(spark, folder):
    return browsing.country_choices(view(spark, folder, "listings"))


@query("city_choices", ["listings"], "SELECT DISTINCT addr_name FROM listings WHERE addr_cc = 'DE'")
def city_choices(spark, folder):
    return browsing.city_choices(view(spark, folder, "listings"), "DE")


@query(
    "display_labels", ["listings"],
    """SELECT property_id, listing_title || ' — ' || addr_name || ' (' || addr_cc || ') | $'
  || coalesce(CAST(price_per_night AS STRING), 'None') || ' | ⭐ ' || CAST(ratings AS STRING) AS label FROM listings""",
)
def display_labels(spark, folder):
    return browsing.with_label(view(spark, folder, "listings")).select("property_id", "label")


@query(
    "display_table", ["listings"],
    """SELECT listing_title AS "Listing", addr_cc AS "Country", addr_name AS "City", ratings AS "Rating"
FROM listings""",
)
def display_table(spark, folder):
    return browsing.with_headers(
        view(spark, folder, "listings"), ["listing_title", "addr_cc", "addr_name", "ratings"]
    )


@query(
    "short_titles", ["listings"],
    """SELECT property_id, CASE WHEN length(listing_title) > 15 THEN substr(listing_title, 1, 12) || '...'
  ELSE listing_title END AS label FROM listings""",
)
def short_titles(spark, folder):
    return view(spark, folder, "listings").select(
        "property_id", truncated(F.col("listing_title")).alias("label")
    )


# --- profiling ------------------------------------------------------------------------
_MISSING = ["price_per_night", "host_rating", "ratings", "guests"]
_ALL_COLUMNS = """property_id listing_title room_type_text addr_cc addr_name lat long price_per_night guests
ratings property_number_of_reviews host_rating host_number_of_reviews host_response_rate hosts_year
rating_cleanliness rating_accuracy rating_checkin rating_communication rating_location rating_value
is_supperhost is_guest_favorite final_url""".split()


def _missing_sql(columns, where=""):
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_pct, count({c}) AS present,
  round(count({c}) * 100e0 / count(*), 2) AS present_pct FROM listings"""
        for c in columns
    )
    return f"SELECT * FROM ({parts}) {where}"


@query("missing_report", ["listings"], _missing_sql(_MISSING, "WHERE missing > 0"))
def missing_report(spark, folder):
    return profiling.missing_values(view(spark, folder, "listings"))


@query("missing_report_all", ["listings"], _missing_sql(_ALL_COLUMNS))
def missing_report_all(spark, folder):
    return profiling.missing_values(view(spark, folder, "listings"), show_all=True)


_NUMBERS = [
    "lat", "long", "price_per_night", "guests", "ratings", "property_number_of_reviews",
    "host_rating", "host_number_of_reviews", "host_response_rate", "hosts_year",
    "rating_cleanliness", "rating_accuracy", "rating_checkin", "rating_communication",
    "rating_location", "rating_value",
]
_TEXTS = ["listing_title", "room_type_text", "addr_name", "final_url"]
_EXPRESSIONS = {c: c for c in _NUMBERS} | {f"len_{c}": f"length({c})" for c in _TEXTS}
_QUARTILES = " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, {e}::DOUBLE AS v FROM listings""" for n, e in _EXPRESSIONS.items()
)
PROFILE_STEPS = {
    "long": _QUARTILES,
    "quarts": """SELECT feature, count(v) AS non_null, min(v) AS min, quantile_disc(v, 0.25) AS q25,
  quantile_disc(v, 0.5) AS median, avg(v) AS mean, stddev_samp(v) AS std, quantile_disc(v, 0.75) AS q75, max(v) AS max
FROM long GROUP BY feature""",
    "fences": """SELECT *, q25 - 1.5e0 * iqr AS lower_fence, q75 + 1.5e0 * iqr AS upper_fence
FROM (SELECT *, CASE WHEN q75 = q25 THEN 0.01e0 ELSE q75 - q25 END AS iqr FROM quarts)""",
    "outside": """SELECT feature, count(*) FILTER (WHERE v < lower_fence OR v > upper_fence) AS outliers
FROM long JOIN fences USING (feature) GROUP BY feature""",
}
_SHOWN = ["min", "q25", "median", "mean", "std", "q75", "max", "lower_fence", "upper_fence"]


@query(
    "distribution_report", ["listings"],
    f"""SELECT feature, non_null, {', '.join(f'round({c}, 2) AS {c}' for c in _SHOWN)}, outliers
FROM fences JOIN outside USING (feature)""",
    PROFILE_STEPS,
)
def distribution_report(spark, folder):
    return profiling.distribution_report(view(spark, folder, "listings"))


@query(
    "distribution_exact", ["listings"],
    f"""SELECT feature, non_null, {', '.join(f'round({c}, 2) AS {c}' for c in _SHOWN)}, outliers
FROM fences JOIN outside USING (feature)""",
    PROFILE_STEPS,
)
def distribution_exact(spark, folder):
    return profiling.distribution_report(view(spark, folder, "listings"), exact=True)


def _appended(spark, folder):
    """The profile of listings that were written in three batches, from the batches' states."""
    listings = view(spark, folder, "listings")
    path = scratch_path(spark, "profile")
    for batch in range(3):
        part = listings.where(F.pmod("property_id", F.lit(3)) == batch)
        profile_state.append_profile(part, path, accuracy=1 << 15)
    return profile_state.stored_profile(spark, path)


@query(
    "profile_appended", ["listings"],
    f"SELECT feature, non_null, {', '.join(f'round({c}, 2) AS {c}' for c in _SHOWN)} FROM fences WHERE non_null > 0",
    {k: v for k, v in PROFILE_STEPS.items() if k != "outside"},
)
def profile_appended(spark, folder):
    return profile_state.distribution_from_state(_appended(spark, folder))


@query("missing_appended", ["listings"], _missing_sql(_ALL_COLUMNS))
def missing_appended(spark, folder):
    return profile_state.missing_from_state(_appended(spark, folder), show_all=True).drop("distinct")


@query("outlier_counts", ["listings"], "SELECT feature, outliers FROM outside", PROFILE_STEPS)
def outlier_counts(spark, folder):
    report = profiling.distribution_report(view(spark, folder, "listings"))
    return report.select("feature", "outliers")


def _histogram_sql(value: str, where: str, bins: int, back: str) -> str:
    return f"""SELECT bin, {back.format('low + bin * width')} AS bin_start,
  {back.format('low + (bin + 1) * width')} AS bin_end, count(*) AS n_rows FROM (
  SELECT low, width, CAST(least(floor((v - low) / width), {bins - 1}) AS BIGINT) AS bin
  FROM (SELECT {value} AS v FROM listings WHERE {where}),
    (SELECT min({value}) AS low, (max({value}) - min({value})) / {bins} AS width FROM listings WHERE {where}))
GROUP BY bin, low, width"""


@query(
    "price_histogram", ["listings"],
    _histogram_sql("ln(price_per_night)", "price_per_night > 0", 100, "round(exp({}), 4)"),
)
def price_histogram(spark, folder):
    bins = profiling.histogram(view(spark, folder, "listings"), "price_per_night", 100, log_scale=True)
    return rounded(bins, "bin_start", "bin_end", digits=4)


@query(
    "rating_histogram", ["listings"],
    _histogram_sql("host_number_of_reviews::DOUBLE", "host_number_of_reviews IS NOT NULL", 30, "round({}, 4)"),
)
def rating_histogram(spark, folder):
    bins = profiling.histogram(view(spark, folder, "listings"), "host_number_of_reviews", 30)
    return rounded(bins, "bin_start", "bin_end", digits=4)


@query(
    "row_sample", ["listings"],
    """SELECT property_id, price_per_night FROM listings
WHERE CAST('0x' || substr(md5('42|' || property_id), 1, 8) AS BIGINT) < 429496729""",
)
def row_sample(spark, folder):
    sampled = profiling.sample_rows(view(spark, folder, "listings"), 0.1, seed=42)
    return sampled.select("property_id", "price_per_night")


# --- coverage --------------------------------------------------------------------------
@query("group_counts", ["pois"], "SELECT poi_group, count(*) AS n_rows FROM pois GROUP BY 1")
def group_counts(spark, folder):
    return coverage.count_by(view(spark, folder, "pois"), "poi_group")


@query("country_counts", ["listings"], "SELECT addr_cc, count(*) AS n_rows FROM listings GROUP BY 1")
def country_counts(spark, folder):
    return coverage.count_by(view(spark, folder, "listings"), "addr_cc")


@query(
    "country_group_counts", ["pois"], "SELECT addr_cc, poi_group, count(*) AS n_rows FROM pois GROUP BY 1, 2"
)
def country_group_counts(spark, folder):
    return coverage.count_by(view(spark, folder, "pois"), "addr_cc", "poi_group")


@query("budget_levels", ["cities"], "SELECT budget_level, count(*) AS n_rows FROM cities GROUP BY 1")
def budget_levels(spark, folder):
    return coverage.count_by(view(spark, folder, "cities"), "budget_level")


_FIRST = "SELECT addr_cc, arg_min(continent, position) AS continent FROM continents GROUP BY addr_cc"


@query(
    "continent_counts", ["listings", "continents"],
    """SELECT coalesce(continent, 'unknown') AS continent, CAST(count(*) AS BIGINT) AS n_rows
FROM listings LEFT JOIN first_of USING (addr_cc) GROUP BY 1""",
    {"first_of": _FIRST},
)
def continent_counts(spark, folder):
    return coverage.continent_counts(view(spark, folder, "listings"), view(spark, folder, "continents"))


@query(
    "continent_files", ["pois", "continents"],
    """SELECT f.continent, CAST(count(*) AS BIGINT) AS n_rows FROM
  (SELECT addr_cc, CASE osm_id % 3 WHEN 0 THEN 'africa' WHEN 1 THEN 'europe' ELSE 'other' END AS continent FROM pois) f
WHERE continent = 'other' OR EXISTS (SELECT 1 FROM continents c WHERE c.continent = f.continent AND c.addr_cc = f.addr_cc)
GROUP BY 1""",
)
def continent_files(spark, folder):
    file_of = F.when(F.col("osm_id") % 3 == 0, "africa").when(F.col("osm_id") % 3 == 1, "europe")
    pois = view(spark, folder, "pois").withColumn("continent", F.coalesce(file_of, F.lit("other")))
    return coverage.continent_file_counts(pois, view(spark, folder, "continents"))


_RAW_NAMES = "Africa,Central America,North-America,Australia,australia_oceania,Asia ,Atlantis"
_CANONICAL = " ".join(f"WHEN '{k}' THEN '{CONTINENT_TITLES[v]}'" for k, v in CANONICAL_CONTINENTS.items())


@query(
    "continent_merge", ["listings"],
    f"""SELECT CASE k {_CANONICAL} ELSE k END AS continent, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT replace(replace(trim(lower(split_part('{_RAW_NAMES}', ',', CAST(property_id % 7 AS INT) + 1))), '-', '_'), ' ', '_') AS k
  FROM listings) GROUP BY 1""",
)
def continent_merge(spark, folder):
    name = F.split_part(F.lit(_RAW_NAMES), F.lit(","), (F.col("property_id") % 7 + 1).cast("int"))
    named = view(spark, folder, "listings").select(name.alias("continent"))
    counts = named.groupBy("continent").agg(F.count("*").alias("n_rows"))
    return coverage.merge_continents(counts, titles=True)


@query(
    "poi_mix", ["pois", "listings"],
    "SELECT addr_cc, "
    + ", ".join(
        f"round(count(*) FILTER (WHERE poi_group = '{g}') * 100e0 / count(*), 6) AS {g}" for g in ENV_GROUPS
    )
    + """ FROM pois WHERE addr_cc IN (SELECT addr_cc FROM (SELECT addr_cc, count(*) AS n FROM listings
  GROUP BY 1 ORDER BY n DESC, addr_cc LIMIT 10)) GROUP BY addr_cc""",
)
def poi_mix(spark, folder):
    mix = coverage.poi_mix(view(spark, folder, "pois"), view(spark, folder, "listings"))
    return rounded(mix, *ENV_GROUPS)


@query(
    "sparsity", ["cities", "continents"],
    """SELECT continent, CAST(sum(n) AS BIGINT) AS total_cities, count(*) AS total_countries,
  round(avg(n), 2) AS avg_cities, round(stddev_samp(n), 2) AS std_cities,
  count(*) FILTER (WHERE n > 0) AS countries_with_data,
  round(count(*) FILTER (WHERE n > 0) * 100e0 / count(*), 1) AS coverage_pct
FROM (SELECT continent, k.addr_cc, (SELECT count(*) FROM cities c WHERE c.addr_cc = k.addr_cc) AS n
  FROM continents k) GROUP BY continent""",
)
def sparsity(spark, folder):
    return coverage.city_sparsity(view(spark, folder, "cities"), view(spark, folder, "continents"))


@query(
    "market_top", ["listings", "cities"],
    """SELECT addr_cc, listings_count, cities_count FROM
  (SELECT addr_cc, count(*) AS listings_count FROM listings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
  LEFT JOIN (SELECT addr_cc, count(*) AS cities_count FROM cities GROUP BY 1) USING (addr_cc)""",
)
def market_top(spark, folder):
    return coverage.market_overview(view(spark, folder, "listings"), view(spark, folder, "cities"))


@query(
    "dataset_totals", ["listings", "pois", "cities"],
    " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, count(*) AS n_rows, count(DISTINCT addr_cc) AS n_countries FROM {t}"
        for t in ("listings", "pois", "cities")
    ),
)
def dataset_totals(spark, folder):
    return coverage.dataset_totals(*[view(spark, folder, t) for t in ("listings", "pois", "cities")])


@query(
    "small_large", ["listings"],
    """SELECT * FROM (SELECT addr_cc, count(*) AS n_rows, 'smallest' AS size FROM listings GROUP BY 1
  HAVING count(*) >= 50 ORDER BY 2, 1 LIMIT 3)
UNION ALL SELECT * FROM (SELECT addr_cc, count(*) AS n_rows, 'largest' AS size FROM listings GROUP BY 1
  HAVING count(*) >= 50 ORDER BY 2 DESC, 1 LIMIT 3)""",
)
def small_large(spark, folder):
    return coverage.smallest_and_largest(view(spark, folder, "listings"))


@query("city_points", ["cities"], "SELECT addr_cc, longitude, latitude FROM cities")
def city_points(spark, folder):
    return coverage.city_points(view(spark, folder, "cities"))


@query(
    "city_points_sample", ["cities"],
    """SELECT addr_cc, longitude, latitude FROM cities
WHERE CAST('0x' || substr(md5('42|' || addr_cc || '|' || addr_name), 1, 8) AS BIGINT) < 2147483648""",
)
def city_points_sample(spark, folder):
    return coverage.city_points(view(spark, folder, "cities"), fraction=0.5)
