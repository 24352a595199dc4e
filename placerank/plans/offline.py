"""From raw tables to scored and embedded listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import BucketedRandomProjectionLSHModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.constants import (
    AMENITY_LIMIT,
    DISPLAY_COLUMNS,
    ENV_COLUMNS,
    EUROPE_CODES,
    N_CANDIDATES,
    PIPELINE_PRICE_CAP,
    SCORE_COLUMNS,
    TARGET_COUNTRIES,
    TEMPERATURE_COLUMNS,
    TEXT_ITEM_LIMIT,
)
from placerank.operators import cleaning, embedding, geography, nested, pricing, scoring
from placerank.operators.neighbours import attach_candidates, every_country, nearest_neighbours
from placerank.sources.scratch import written
from placerank.sources.tables import read_table, write_by_country, write_neighbours

RANKING_COLUMNS = [
    *SCORE_COLUMNS,
    *[f"{c}_norm" for c in ENV_COLUMNS],
    "budget_level",
    "budget_rank",
    *TEMPERATURE_COLUMNS,
]


def clean_listings(
    raw: DataFrame, gazetteer: DataFrame, max_price: float = PIPELINE_PRICE_CAP
) -> DataFrame:
    """Raw listings to the final listing columns.

    Means for imputation are taken before the price cap, as the cap only applies
    to imputed prices.  Runs jobs: the unique rows and the priced rows are written
    once, as places and means are found in a pass of their own.
    """
    typed = cleaning.cast_types(cleaning.select_raw_columns(raw))
    unique = written(cleaning.one_per_key(typed), "listings")
    parsed = (
        unique.transform(nested.extract_listing_features, AMENITY_LIMIT, TEXT_ITEM_LIMIT)
        .transform(nested.parse_pricing)
        .transform(nested.parse_ratings)
    )
    priced = (
        geography.nearest_place(parsed, gazetteer)
        .transform(cleaning.drop_incomplete)
        .transform(cleaning.fill_defaults)
        .transform(pricing.derive_nightly_price)
        .transform(pricing.prices_to_usd)
    )
    return (
        pricing.impute(written(priced, "priced"))
        .transform(cleaning.fill_description)
        .transform(cleaning.cap_price, max_price)
        .transform(cleaning.add_logs)
        .transform(cleaning.select_final_columns)
    )


def integrate(
    listings: DataFrame,
    cities: DataFrame,
    pois: DataFrame,
    codes: Sequence[str] = tuple(EUROPE_CODES),
) -> DataFrame:
    """City facts and surroundings for all listed countries in one job.

    The country is part of every join key, so countries need no loop.
    """

    def scope(df: DataFrame) -> DataFrame:
        return df.where(F.col("addr_cc").isin(list(codes)))

    joined = geography.join_cities(scope(listings), scope(cities))
    return geography.attach_environment(joined, scope(pois))


def score(listings: DataFrame) -> DataFrame:
    return scoring.score_all(listings)


def build_models(
    scored_path: str,
    embedded_path: str,
    model_path: str,
    index_path: str,
    spark,
) -> tuple[PipelineModel, BucketedRandomProjectionLSHModel]:
    """Fit and save the embedding, the vectors by country, and the index."""
    scored = read_table(spark, scored_path)
    model = embedding.fit_embedding(scored)
    model.write().overwrite().save(model_path)
    write_by_country(embedding.embed(scored, model), embedded_path)
    index = embedding.fit_lsh(read_table(spark, embedded_path))
    index.write().overwrite().save(index_path)
    return model, index


def load_models(model_path: str, index_path: str) -> tuple[PipelineModel, BucketedRandomProjectionLSHModel]:
    return PipelineModel.load(model_path), BucketedRandomProjectionLSHModel.load(index_path)


def precompute_neighbours(
    embedded: DataFrame,
    scored: DataFrame,
    sample: DataFrame,
    countries: Sequence[str] = tuple(TARGET_COUNTRIES),
    n: int = N_CANDIDATES,
    **options,
) -> DataFrame:
    """Nearest listings of every sampled listing in every target country."""
    found = nearest_neighbours(embedded, every_country(sample, countries), n, **options)
    return attach_candidates(found, scored, [*DISPLAY_COLUMNS, *RANKING_COLUMNS])


def save_neighbours(neighbours: DataFrame, path: str) -> None:
    write_neighbours(neighbours, path)
