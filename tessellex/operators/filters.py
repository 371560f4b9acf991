"""Metadata filters compiled to one Boolean Column.

``compile_filter`` follows the dense side (typed comparison), ``match_text`` the
sparse side (lower-case string comparison). Both are plain Column predicates, so
Catalyst pushes them to the parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = {
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
}
_OPERATORS = {
    **_RANGE,
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)),
}


def _column(name: str) -> Column:
    return F.col(name.removeprefix("meta_"))


def _all(parts: Iterable[Column]) -> Column | None:
    parts = list(parts)
    return reduce(and_, parts) if parts else None


def _condition(name: str, value: Any) -> Column | None:
    column = _column(name)
    if isinstance(value, Mapping):
        return _all(_OPERATORS[op](column, v) for op, v in value.items() if v is not None)
    if isinstance(value, (list, tuple, set)):
        return column.isin(list(value))
    return column == value


def compile_filter(filters: Mapping[str, Any] | None) -> Column | None:
    """Scalar = equals, list = membership, mapping = operators; all must hold.

    NULL when there is nothing to filter on, so that callers can tell an empty
    filter (delete nothing) from one that matches everything.
    """
    conditions = (_condition(k, v) for k, v in (filters or {}).items())
    return _all(c for c in conditions if c is not None)


def compile_conditions(conditions: Iterable[tuple[str, str, Any]]) -> Column | None:
    """Filter from ``(field, operator, value)`` triples."""
    return _all(_OPERATORS[op](_column(field), value) for field, op, value in conditions)


def match_text(filters: Mapping[str, Any] | None) -> Column | None:
    """Compare as lower-case strings; a missing value never matches."""

    def one(name: str, value: Any) -> Column:
        wanted = value if isinstance(value, (list, tuple, set)) else [value]
        actual = F.lower(_column(name).cast("string"))
        return F.coalesce(actual.isin([str(v).lower() for v in wanted]), F.lit(False))

    return _all(one(k, v) for k, v in (filters or {}).items())


def above(score: Column, threshold: float) -> Column:
    """Score threshold; only a positive threshold filters."""
    return score >= threshold if threshold > 0 else F.lit(True)
