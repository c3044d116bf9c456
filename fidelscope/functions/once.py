"""Evaluating an expensive expression once.

Catalyst moves a filter below the projection that computes its column, and so evaluates the
column's expression for the filter and again for the output.  It does not move filters below a
generator, and it binds a lambda's argument once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_fields(df: DataFrame, row: Column, *drop: str) -> DataFrame:
    """Add the fields of a struct, computed once per row whatever is filtered afterwards."""
    return df.select(*(c for c in df.columns if c not in drop), F.inline(F.array(row)))


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, computed once per row whatever is filtered afterwards."""
    return with_fields(df, F.struct(*(c.alias(n) for n, c in columns.items())))
