"""All named queries and their SQL."""

from lodeworks.plans import relational, sequences, texts  # noqa: F401
from lodeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
