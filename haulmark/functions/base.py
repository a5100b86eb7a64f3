"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(value) -> Column:
    """Accept a column name or a column."""
    return value if isinstance(value, Column) else F.col(value)


def flag(condition: Column) -> Column:
    """A comparison with a missing side counts as false, never as unknown."""
    return F.coalesce(condition, F.lit(False))


def pct(condition: Column, digits: int = 4) -> Column:
    """Share of rows for which a non-null condition holds, in percent."""
    return F.round(F.avg(condition.cast("double")) * 100, digits)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
