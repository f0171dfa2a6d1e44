"""Lookups and updates by key.

Every table joined here is first brought to one row per key, and its keys to
one each, before it is moved. The other side may repeat a key as often as it likes: such joins
are left or inner joins whose large side adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.falsy import blank_to_null


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row that comes first per key."""
    return _first(df, key, [F.asc(name) for name in order])


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row that comes last per key."""
    return _first(df, key, [F.desc(name) for name in order])


def _first(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key. A limit on the window lets every task send one row of each key at most."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def insert_unique(
    existing: DataFrame, new: DataFrame, key: str, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``(inserted, conflicts)``: the first new row per unused key, and the rest.

    ``order`` must identify a row of ``new`` among the rows of its key. A row
    without a key cannot be looked up and is a conflict.
    """
    taken = existing.select(key).distinct()
    winners = first_per_key(new.where(F.col(key).isNotNull()), key, order).join(taken, key, "left_anti")
    mark = winners.select(key, F.struct(*order).alias("_won"))
    judged = new.join(mark, key, "left")
    lost = ~F.coalesce(F.col("_won") == F.struct(*order), F.lit(False))
    conflicts = judged.where(lost).select(*new.columns)
    return winners, conflicts


def update_by_key(base: DataFrame, patch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(updated, unmatched)``: non-null patch columns written over ``base``.

    ``patch`` has one row per key; ``unmatched`` are its rows without a record.
    """
    changed = [name for name in patch.columns if name != key]
    fresh = patch.select(key, *[F.col(name).alias(f"_new_{name}") for name in changed])
    joined = base.join(fresh, key, "left")
    updated = joined.select(
        *[
            F.coalesce(f"_new_{name}", name).alias(name) if name in changed else F.col(name)
            for name in base.columns
        ]
    )
    return updated, patch.join(base.select(key).distinct(), key, "left_anti")


def users_by_email(
    users: DataFrame,
    emails: DataFrame,
    email: str = "Email",
    order: list[str] | None = None,
    hidden: tuple[str, ...] = ("Password", "password"),
) -> DataFrame:
    """First user per asked e-mail; password columns are never read."""
    shown = users.drop(*hidden).where(blank_to_null(F.col(email)).isNotNull())
    asked = emails.select(email).distinct()
    return first_per_key(shown.join(asked, email, "left_semi"), email, order or ["Id"])


def table_columns(spark, table: str) -> DataFrame:
    """``(name, data_type)`` of a catalog table's columns."""
    rows = [(field.name, field.dataType.simpleString()) for field in spark.table(table).schema]
    return spark.createDataFrame(rows, "name string, data_type string")
