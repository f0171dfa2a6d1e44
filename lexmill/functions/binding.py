"""Naming a value inside an expression, so that it is computed once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand(df: DataFrame, keep: list[str], value: Column) -> DataFrame:
    """``keep`` columns with the fields of the struct ``value``, computed once per row.

    Filters on the new columns stay above the computation.
    """
    return df.select(*keep, F.inline(F.array(value)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``.

    A column used many times in a filter is copied into it by predicate
    pushdown and then computed at each use. A lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
