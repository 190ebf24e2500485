"""Query definitions over the sample tables, grouped by subject."""

from ledgerlife.plans import cohorts, features, metrics, modelling, relational, stages, survival  # noqa: F401
from ledgerlife.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
