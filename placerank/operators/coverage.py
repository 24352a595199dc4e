"""Counts by country, continent and group.

Continent membership is an input table with the columns ``continent``,
``addr_cc`` and ``position``; a country may belong to several continents, and
``position`` says which comes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placerank.constants import CANONICAL_CONTINENTS, CONTINENT_TITLES, ENV_GROUPS, SUITE_MIN_ROWS
from placerank.functions.expressions import seeded_share


def continent_table(spark: SparkSession, continents: Mapping[str, Sequence[str]]) -> DataFrame:
    """The membership table of a mapping from continent to country codes."""
    rows = [
        (continent, code, position)
        for position, (continent, codes) in enumerate(continents.items())
        for code in codes
    ]
    return spark.createDataFrame(rows, "continent string, addr_cc string, position int")


def count_by(df: DataFrame, *columns: str, name: str = "n_rows") -> DataFrame:
    """Rows per group; rows without a group are left out."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias(name))


def with_continent(df: DataFrame, continents: DataFrame) -> DataFrame:
    """The first continent a row's country is listed under, else ``unknown``."""
    first = continents.groupBy("addr_cc").agg(
        F.min_by("continent", F.struct("position", "continent")).alias("continent")
    )
    return (
        df.drop("continent")
        .join(first, "addr_cc", "left")
        .withColumn("continent", F.coalesce("continent", F.lit("unknown")))
    )


def continent_counts(df: DataFrame, continents: DataFrame) -> DataFrame:
    """Rows per continent, countries counted under their first one.

    Rows are counted per country before the continents are joined.
    """
    per_country = count_by(df, "addr_cc")
    return (
        with_continent(per_country, continents)
        .groupBy("continent")
        .agg(F.sum("n_rows").alias("n_rows"))
    )


def continent_file_counts(pois: DataFrame, continents: DataFrame) -> DataFrame:
    """Rows per continent file that lie in one of that continent's countries.

    ``pois`` carries the continent of its file in ``continent``.  A country on
    two continents counts in each of their files; a file of a continent without
    listed countries counts whole.
    """
    counted = pois.groupBy("continent", "addr_cc").agg(F.count("*").alias("n_rows"))
    listed = continents.select("continent", "addr_cc").distinct()
    known = listed.select("continent").distinct()
    inside = counted.join(listed, ["continent", "addr_cc"], "left_semi")
    unlisted = counted.join(known, "continent", "left_anti")
    return (
        inside.unionByName(unlisted)
        .groupBy("continent")
        .agg(F.sum("n_rows").alias("n_rows"))
    )


def canonical_continent(name: Column, titles: bool = False) -> Column:
    """A continent's canonical name; unknown names are only normalised."""
    key = F.regexp_replace(F.trim(F.lower(name)), "[- ]", "_")
    pairs = []
    for raw, canonical in CANONICAL_CONTINENTS.items():
        shown = CONTINENT_TITLES[canonical] if titles else canonical
        pairs += [F.lit(raw), F.lit(shown)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def merge_continents(counts: DataFrame, titles: bool = False) -> DataFrame:
    """Counts summed over the names that mean one continent."""
    return (
        counts.groupBy(canonical_continent(F.col("continent"), titles).alias("continent"))
        .agg(F.sum("n_rows").alias("n_rows"))
    )


def top_countries(df: DataFrame, k: int, name: str = "n_rows") -> DataFrame:
    return count_by(df, "addr_cc", name=name).orderBy(F.desc(name), "addr_cc").limit(k)


def poi_mix(
    pois: DataFrame, listings: DataFrame, k: int = 10, groups: Sequence[str] = tuple(ENV_GROUPS)
) -> DataFrame:
    """Share of each group among a country's points, in percent, top ``k`` countries.

    The top countries are those with most listings; groups become columns.
    """
    markets = top_countries(listings, k).select("addr_cc")
    counted = count_by(pois, "addr_cc", "poi_group").join(markets, "addr_cc", "left_semi")
    wide = counted.groupBy("addr_cc").agg(
        F.sum("n_rows").alias("total"),
        *[
            F.sum(F.when(F.col("poi_group") == g, F.col("n_rows")).otherwise(0)).alias(g)
            for g in groups
        ],
    )
    return wide.select("addr_cc", *[(F.col(g) * 100.0 / F.col("total")).alias(g) for g in groups])


def city_sparsity(cities: DataFrame, continents: DataFrame) -> DataFrame:
    """How many cities each continent's countries have, countries without any included."""
    counted = count_by(cities, "addr_cc", name="n_cities")
    universe = continents.select("continent", "addr_cc").join(counted, "addr_cc", "left").fillna(
        0, subset=["n_cities"]
    )
    covered = F.count_if(F.col("n_cities") > 0)
    return (
        universe.groupBy("continent")
        .agg(
            F.sum("n_cities").alias("total_cities"),
            F.count("*").alias("total_countries"),
            F.round(F.avg("n_cities"), 2).alias("avg_cities"),
            F.round(F.stddev_samp("n_cities"), 2).alias("std_cities"),
            covered.alias("countries_with_data"),
            F.round(covered * 100.0 / F.count("*"), 1).alias("coverage_pct"),
        )
        .orderBy(F.desc("avg_cities"), "continent")
    )


def market_overview(listings: DataFrame, cities: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` largest markets with their number of cities beside them."""
    hubs = count_by(cities, "addr_cc", name="cities_count")
    return top_countries(listings, k, "listings_count").join(hubs, "addr_cc", "left")


def dataset_totals(listings: DataFrame, pois: DataFrame, cities: DataFrame) -> DataFrame:
    """Size of each dataset and the number of countries with listings."""

    def one(df: DataFrame, dataset: str) -> DataFrame:
        return df.agg(
            F.lit(dataset).alias("dataset"),
            F.count("*").alias("n_rows"),
            F.countDistinct("addr_cc").alias("n_countries"),
        )

    return one(listings, "listings").unionByName(one(pois, "pois")).unionByName(
        one(cities, "cities")
    )


def smallest_and_largest(
    df: DataFrame, n: int = 3, min_rows: int = SUITE_MIN_ROWS
) -> DataFrame:
    """The ``n`` smallest and ``n`` largest countries of at least ``min_rows`` rows."""
    counted = count_by(df, "addr_cc").where(F.col("n_rows") >= min_rows)
    smallest = counted.orderBy("n_rows", "addr_cc").limit(n)
    largest = counted.orderBy(F.desc("n_rows"), "addr_cc").limit(n)
    return smallest.withColumn("size", F.lit("smallest")).unionByName(
        largest.withColumn("size", F.lit("largest"))
    )


def city_points(
    cities: DataFrame, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Coordinates of cities for a map, or of a seeded sample of them."""
    if fraction is not None:
        cities = cities.where(seeded_share(fraction, seed, "addr_cc", "addr_name"))
    return cities.select("addr_cc", "longitude", "latitude")
