"""Registered queries."""

from chatloom.plans import audit, corpus, evaluation, service  # noqa: F401
from chatloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
