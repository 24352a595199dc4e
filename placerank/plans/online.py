"""One user's request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerank.constants import N_CANDIDATES, RESULT_COLUMNS, TARGET_COUNTRIES
from placerank.functions.expressions import present
from placerank.operators.neighbours import retrieve
from placerank.operators.ranking import Preferences, check_request, rank


def recommend(
    embedded: DataFrame,
    scored: DataFrame,
    target_id,
    country: str,
    prefs: Preferences,
    k: int = 10,
    n: int = N_CANDIDATES,
    allowed: Sequence[str] = tuple(TARGET_COUNTRIES),
    **options,
) -> DataFrame:
    """The ``k`` best of the ``n`` listings nearest to one listing in a country.

    The country must be one of ``allowed``; an empty list allows all.
    """
    _, code = check_request(target_id, country, allowed)
    candidates = retrieve(embedded, target_id, code, n, **options)
    taken = [c for c in candidates.columns if c != "property_id"]
    facts = scored.select(*[c for c in scored.columns if c not in taken])
    return rank(candidates.join(facts, "property_id"), prefs, k)


def recommend_stored(
    neighbours: DataFrame,
    target_id,
    country: str,
    prefs: Preferences,
    k: int = 10,
    allowed: Sequence[str] = tuple(TARGET_COUNTRIES),
) -> DataFrame:
    """The same from precomputed neighbours."""
    source, code = check_request(target_id, country, allowed)
    stored = neighbours.where(
        (F.col("src_property_id").cast("string") == source) & (F.col("target_cc") == code)
    )
    return rank(stored, prefs, k)


def shown(ranked: DataFrame, columns: Sequence[str] = tuple(RESULT_COLUMNS)) -> DataFrame:
    return ranked.select(*present(ranked, columns))
