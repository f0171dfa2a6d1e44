"""Defaults for missing values: ``falsy`` treats "" like null, ``??`` does not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def or_default(col: Column, default: str | Column) -> Column:
    """First value that is neither null nor the empty string."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(blank_to_null(col), default)
