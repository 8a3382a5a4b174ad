"""Column helpers for rows that carry a whole molecule."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst inlines a column that is used once, even into a lambda that runs per element;
    binding it to a lambda variable keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(items: Column, of: Callable[[Column], Column], kind: str = "int") -> Column:
    return F.aggregate(items, F.lit(0).cast(kind), lambda s, x: s + of(x).cast(kind))


def count_if(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test))
