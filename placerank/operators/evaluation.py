"""Query suites and the tables that judge retrieval."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.constants import EUROPE_CODES, N_CANDIDATES
from placerank.functions.expressions import seeded_order, truncated
from placerank.operators.neighbours import (
    farthest,
    nearest_neighbours,
    pick_rows,
    with_cosine,
)
from placerank.operators.selection import exact_quantiles
from placerank.sources.scratch import written


def country_pool(
    df: DataFrame, seed: int, exclude: Iterable[str] = (), codes: Sequence[str] = tuple(EUROPE_CODES)
) -> list[str]:
    """Countries of the data among ``codes``, in an order that the seed fixes.

    The list is never longer than ``codes``.
    """
    allowed = [c for c in codes if c not in set(exclude)]
    found = (
        df.select(F.upper("addr_cc").alias("cc"))
        .where(F.col("cc").isin(allowed))
        .distinct()
        .orderBy(seeded_order(seed, "cc"), "cc")
    )
    return [row["cc"] for row in found.collect()]


def pick_diverse(
    embedded: DataFrame,
    n_picks: int,
    seed: int = 0,
    exclude: Iterable[str] = (),
    vector: str = "features_norm",
) -> tuple[DataFrame, list[str]]:
    """Listings far from one another, each of another country; and the countries left.

    The first is any listing of the first country.  Each next one is, in the
    next country, the listing with the largest summed distance to all earlier
    picks.  Every step reads one country once.
    """
    pool = country_pool(embedded, seed, exclude)
    if len(pool) < n_picks:
        raise ValueError(f"{n_picks} picks need as many countries; there are {len(pool)}")
    first = (
        embedded.where(F.upper("addr_cc") == pool[0])
        .orderBy(seeded_order(seed, "property_id"), "property_id")
        .select("property_id")
        .first()["property_id"]
    )
    picks = [(first, pool[0], None)]
    rows = pick_rows(embedded, [first], vector)
    for country in pool[1:n_picks]:
        chosen, total = farthest(embedded, country, rows, vector)
        picks.append((chosen, country, total))
        rows += pick_rows(embedded.where(F.upper("addr_cc") == country), [chosen], vector)
    id_type = embedded.schema["property_id"].dataType.simpleString()
    table = embedded.sparkSession.createDataFrame(
        picks, f"property_id {id_type}, country_code string, total_dist double"
    )
    return table, pool[n_picks:]


def one_destination_suite(
    embedded: DataFrame, n_picks: int, seed: int = 0, vector: str = "features_norm"
) -> DataFrame:
    """Each pick with one destination of its own that no pick comes from."""
    picks, pool = pick_diverse(embedded, n_picks, seed, vector=vector)
    if len(pool) < n_picks:
        raise ValueError(f"{n_picks} destinations are needed; {len(pool)} countries are left")
    rows = [
        (row["property_id"], row["country_code"], destination)
        for row, destination in zip(picks.collect(), pool)
    ]
    id_type = embedded.schema["property_id"].dataType.simpleString()
    return embedded.sparkSession.createDataFrame(
        rows, f"property_id {id_type}, country_code string, dest_country string"
    )


def many_destination_suite(
    embedded: DataFrame,
    n_picks: int,
    destinations: Sequence[str] | int,
    seed: int = 0,
    vector: str = "features_norm",
) -> DataFrame:
    """Each pick with every destination: the ones listed, or that many of the pool."""
    if isinstance(destinations, int):
        destinations = country_pool(embedded, seed)[-destinations:] if destinations else []
    picks, _ = pick_diverse(embedded, n_picks, seed, destinations, vector)
    every = F.explode(F.array(*[F.lit(c) for c in destinations]))
    return picks.select("property_id", "country_code", every.alias("dest_country"))


def suite_targets(listings: DataFrame, suite: DataFrame) -> DataFrame:
    """The listings a suite starts from."""
    return listings.join(suite.select("property_id").distinct(), "property_id", "left_semi")


def suite_results(
    embedded: DataFrame,
    listings: DataFrame,
    suite: DataFrame,
    n: int = N_CANDIDATES,
    vector: str = "features_norm",
) -> DataFrame:
    """Nearest candidates of every suite row in one search, with listing columns."""
    requests = suite.withColumnRenamed("dest_country", "target_cc")
    origin = suite.select(
        F.col("property_id").alias("target_id"), F.col("country_code").alias("target_cc")
    ).distinct()
    found = nearest_neighbours(embedded, requests, n, vector).select(
        F.col("neighbor_property_id").alias("cand_id"),
        F.col("target_cc").alias("cand_cc"),
        F.col("src_property_id").alias("target_id"),
        "l2_dist",
    )
    facts = listings.withColumn("cand_id", F.col("property_id"))
    clash = set(found.columns) | {"target_cc", "cosine_similarity"}
    facts = facts.select("cand_id", *[c for c in listings.columns if c not in clash])
    return with_cosine(found.join(origin, "target_id")).join(facts, "cand_id")


def suite_top(results: DataFrame, target_id, country: str, k: int = 5) -> DataFrame:
    """The ``k`` nearest candidates of one suite row."""
    chosen = (F.col("target_id") == target_id) & (F.col("cand_cc") == country)
    return results.where(chosen).orderBy("l2_dist", "cand_id").limit(k)


def median_table(
    results: DataFrame, titles: DataFrame, countries: Sequence[str], digits: int = 3
) -> DataFrame:
    """Median similarity per target and country, with medians of both margins.

    The last row holds each country's median over targets and, in the last
    column, the median of all cells; these are found by selection when this is called.  Cells, one per target and country, are written
    once, as the rows and the last row read them.
    """
    cells = written(
        results.groupBy("target_id", "cand_cc").agg(F.median("cosine_similarity").alias("cell")),
        "cells",
    )

    def of(country: str) -> Column:
        return F.when(F.col("cand_cc") == country, F.col("cell"))

    listed = F.when(F.col("cand_cc").isin(list(countries)), F.col("cell"))
    medians = [F.median(of(c)).alias(c) for c in countries]
    margin = F.median(listed).alias("target_property_median")
    per_target = (
        cells.groupBy("target_id")
        .agg(*medians, margin)
        .withColumn("target_id", F.col("target_id").cast("string"))
    )
    names = titles.select(F.col("property_id").cast("string").alias("target_id"), "listing_title")
    # Columns over all targets are as long as there are targets; no task holds one of them.
    wide = cells.select(*[of(c).alias(c) for c in countries], listed.alias("target_property_median"))
    whole = exact_quantiles(wide, wide.columns, [0.5])
    summary = cells.sparkSession.range(1).select(
        F.lit("country_median").alias("target_id"),
        F.lit("Country Median").alias("listing_title"),
        *[F.lit(whole[c][0]).cast("double").alias(c) for c in wide.columns],
    )
    rows = per_target.join(names, "target_id", "left").unionByName(summary)
    last = F.col("target_id") == "country_median"
    shown = [F.round(c, digits).alias(c) for c in [*countries, "target_property_median"]]
    return rows.orderBy(last, F.desc("target_property_median"), "target_id").select(
        "target_id", "listing_title", *shown
    )


def similarity_by_country(
    results: DataFrame, titles: DataFrame, countries: Sequence[str], max_label: int = 17
) -> DataFrame:
    """One row per candidate: its similarity in the column of its country, else null."""
    labels = titles.select(
        F.col("property_id").alias("target_id"),
        truncated(F.col("listing_title"), max_label).alias("label"),
    )
    columns = [
        F.when(F.col("cand_cc") == c, F.col("cosine_similarity")).alias(c) for c in countries
    ]
    return results.select("target_id", *columns).join(labels, "target_id")
