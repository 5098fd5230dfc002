"""All queries of the library over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from platewise.plans import (  # noqa: F401  (each registers its queries)
    aggregate_queries,
    image_queries,
    incremental_queries,
    regression_queries,
    relational_queries,
    sampling_queries,
    scalar_queries,
    source_queries,
)
from platewise.plans.registry import ORACLES, QUERIES

FLAGSHIP = "bootstrap_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
