"""All registered queries, grouped by operator family."""

from sensorloom.plans.registry import ORACLES, QUERIES
from sensorloom.plans import (  # noqa: F401
    q_sources,
    q_windows,
    q_joins,
    q_features,
    q_labels,
    q_summaries,
    q_places,
    q_models,
)

__all__ = ["ORACLES", "QUERIES"]
