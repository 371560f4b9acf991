"""All registered queries."""

from tessellex.plans import answers, extraction, retrieval, storage  # noqa: F401
from tessellex.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
