"""All registered queries."""

from __future__ import annotations

from bytesieve.plans import registry
from bytesieve.plans import (  # noqa: F401  (register on import)
    curation_queries, evaluation_queries, feature_queries, scoring_queries, segment_queries, source_queries,
    streaming_queries, telemetry_queries, triage_queries,
)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
