"""All queries of the evaluation analytics, gathered from the modules that register them."""

from gaugeworks.plans import (  # noqa: F401
    dispatch_queries,
    inference_queries,
    ledger_queries,
    regression_queries,
    sampling_queries,
    scoring_queries,
    study_queries,
    synthetic_queries,
    text_queries,
    vector_queries,
)
from gaugeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
