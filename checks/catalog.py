"""All queries, in the order of the model's stages."""

from checks import (  # noqa: F401
    cleaning_queries,
    geography_queries,
    score_queries,
    retrieval_queries,
    browse_queries,
    suite_queries,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
