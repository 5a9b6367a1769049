"""Null-safe and tolerant comparison predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tolerances of the diagnostic checks.
EPS_MONEY = 0.011
EPS_TENTH = 0.051
EPS_FORMULA = 0.01


def differs(left: Column, right: Column) -> Column:
    """NULL differs from a value and equals NULL; never NULL itself."""
    return ~left.eqNullSafe(right)


def differs_beyond(left: Column, right: Column, eps: float) -> Column:
    """One side NULL, or both present and further apart than ``eps``."""
    gap = F.abs(left - right) > F.lit(eps)
    return (left.isNull() != right.isNull()) | F.coalesce(gap, F.lit(False))


def beyond(left: Column, right: Column, eps: float) -> Column:
    """Both present and further apart than ``eps``; rows with a NULL are not flagged."""
    return F.coalesce(F.abs(left - right) > F.lit(eps), F.lit(False))
