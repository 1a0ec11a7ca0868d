"""All queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstile.operators import bounds, evals, folds, gate, merging, pictures, reconcile, reports, review, search, spatial, stats, stories, texts  # noqa: F401  (they register)
from turnstile.plans import registry
from turnstile.plans.registry import apply  # noqa: F401  (for users)

Query = Callable[[SparkSession, str], DataFrame]

#: Name of the query that ``entry`` runs.
FLAGSHIP = "cosine_top1"


def queries() -> dict[str, Query]:
    return {name: registry.spark_query(name) for name in registry.names()}


def oracle_sql() -> dict[str, str]:
    return registry.oracles()
