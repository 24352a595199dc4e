"""Build a query suite, run it and write everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from placerank.constants import SUITE_PICKS, SUITE_REPORT_COLUMNS
from placerank.functions.expressions import environment_columns, present
from placerank.operators.cleaning import one_per_key
from placerank.operators.coverage import smallest_and_largest
from placerank.operators.evaluation import (
    many_destination_suite,
    suite_results,
    suite_targets,
    suite_top,
)
from placerank.operators.ranking import preset_preferences, rank_under
from placerank.sources.tables import read_table, write_report_csv, write_table


def build_suite(
    spark: SparkSession,
    listings_path: str,
    embedded_path: str,
    suite_path: str,
    targets_path: str,
    results_path: str,
    n_picks: int = SUITE_PICKS,
    seed: int = 0,
) -> None:
    """Destinations are the three smallest and three largest countries."""
    listings = one_per_key(read_table(spark, listings_path))
    embedded = read_table(spark, embedded_path).dropDuplicates(["property_id"])
    ends = smallest_and_largest(listings).collect()
    destinations = list(dict.fromkeys(row["addr_cc"] for row in ends))
    write_table(many_destination_suite(embedded, n_picks, destinations, seed), suite_path)
    suite = read_table(spark, suite_path)
    write_table(suite_targets(listings, suite), targets_path)
    write_table(suite_results(embedded, listings, suite), results_path)


def report_presets(
    results: DataFrame,
    target_id,
    country: str,
    folder: str,
    k: int = 5,
    columns: Sequence[str] = tuple(SUITE_REPORT_COLUMNS),
) -> None:
    """The nearest candidates of one suite row, and their order under each preset, as CSV."""
    nearest = suite_top(results, target_id, country, k)
    write_report_csv(nearest.select(*present(nearest, columns)), f"{folder}/{target_id}_{country}")
    candidates = results.where(
        (results.target_id == target_id) & (results.cand_cc == country)
    )
    presets = preset_preferences(environment_columns(results.columns))
    ordered = rank_under(candidates, presets, k)
    for name in presets:
        chosen = ordered.where(ordered.preset == name).orderBy("place")
        write_report_csv(
            chosen.select("final_score", *present(ordered, columns)),
            f"{folder}/{name}_{target_id}_{country}",
        )
