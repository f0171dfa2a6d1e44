"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.session import shared_dir

# monotonically_increasing_id() keeps the row's place in its partition in the low 33 bits.
PLACE_BITS = 33


def with_row_index(df: DataFrame, order: list, name: str = "row_index") -> DataFrame:
    """Adds the 0-based place of each row under ``order``, which must be total.

    The sorted rows are checkpointed, so the partitions that are counted are
    the partitions that are numbered. Only one row per partition is summed up.
    """
    shared_dir(df.sparkSession)
    placed = (
        df.sort(*order)
        .checkpoint(eager=True)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", PLACE_BITS))
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_slot") - F.shiftleft("_part", PLACE_BITS) + F.col("_start")
    # One row per partition: bounded by the width of the sort.
    return placed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_slot", "_part", "_start")


def assign_ids(df: DataFrame, start: int, order: list, id_col: str = "Id") -> DataFrame:
    """Identity numbers from ``start`` in ``order``."""
    return with_row_index(df, order, id_col).withColumn(id_col, F.col(id_col) + F.lit(start).cast("bigint"))


def assign_batches(df: DataFrame, order: list, size: int = V.UPSERT_BATCH, name: str = "batch") -> DataFrame:
    """Number of the batch of ``size`` rows that each row is sent in."""
    numbered = with_row_index(df, order, "_index")
    return numbered.withColumn(name, F.floor(F.col("_index") / size)).drop("_index")
