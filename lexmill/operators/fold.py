"""A log of history commands folded into the table it leaves behind.

The order of commands matters only per record, and one record may own a large
share of the log. So the log is cut into slices of about equal size along its
order (time, then number), a window works on the commands of one record in one
slice, and each such piece is summed up in one row. A record then folds its few
pieces in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import fixed_values as V
from lexmill.functions import json_meta as meta
from lexmill.functions.binding import expand, let
from lexmill.operators.history import PATCH_KEYS, UNREADABLE, patch_error

SLICE_ROWS = 1_000_000


def judge_commands(commands: DataFrame, keys: tuple[str, ...] = PATCH_KEYS, error_of=patch_error) -> DataFrame:
    """Adds ``_body`` and ``error`` to the log: each patch read once, under the rules of a direct change.

    ``_body`` is a patch reduced to ``keys``; ``error`` names its invalid key, or says that it cannot be read.
    """

    def judge(parsed: Column) -> Column:
        unreadable = F.when(meta.is_unreadable(F.col("body"), parsed), F.lit(UNREADABLE))
        return let(
            meta.parsed_patch(parsed, keys),
            lambda body: F.struct(body.alias("_body"), F.coalesce(unreadable, error_of(body)).alias("error")),
        )

    patch = F.when(F.col("cmd") == "patch", F.col("body"))
    return expand(commands, commands.columns, let(meta.safe_json_parse(patch), judge)).withColumn(
        "error", F.when(F.col("cmd") == "patch", F.col("error"))
    )


def fold_history(
    commands: DataFrame,
    as_of,
    days: int = V.RETENTION_DAYS,
    keys: tuple[str, ...] = PATCH_KEYS,
    error_of=patch_error,
    slices: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(records, refused)``.

    ``records`` are the survivors, ``(Id, CreatedAt, UpdatedAt, DeletedAt, AnalysisJson)``;
    ``refused`` are the patches that a direct change would refuse, with ``error``. They have no effect.

    ``commands`` holds ``Id, ts, seq, cmd, body`` with cmd one of save, delete,
    restore, patch, purge (others have no effect); ``body`` is JSON text: the
    analysis of a save, the meta or signature patch of a patch. ``keys`` are the
    keys a patch may set; others are left out.

    Commands before a record's first save find nothing, later saves are
    ignored, a purge is final, and a record that stays in the trash for more
    than ``days`` days is removed, whatever comes after.
    """
    known = commands.where(F.col("cmd").isin("save", "delete", "restore", "patch", "purge"))
    judged = judge_commands(known, keys, error_of)
    log = judged.where(F.col("error").isNull())
    # The order does not need the bodies, so only the narrow columns are cut into slices.
    states = _fold_states(_pieces(slice_log(log.select("Id", "ts", "seq", "cmd"), slices), days), days)
    cutoff = F.lit(as_of).cast(commands.schema["ts"].dataType) - F.make_dt_interval(F.lit(days))
    kept = states.where(F.col("saved") & ~F.col("gone")).where(
        F.col("DeletedAt").isNull() | (F.col("DeletedAt") >= cutoff)
    )
    bodies = (
        log.where(F.col("cmd") == "save").groupBy("Id").agg(F.min_by("body", F.struct("ts", "seq")).alias("_saved"))
    )
    joined = kept.join(bodies, "Id").join(_last_values(log), "Id", "left")
    later = F.filter("_values", lambda value: value["at"] > F.col("created"))
    patch = F.map_from_entries(F.transform(later, lambda value: F.struct(value["key"], value["value"])))
    records = joined.select(
        "Id",
        F.col("created.ts").alias("CreatedAt"),
        F.greatest("DeletedAt", "UpdatedAt").alias("UpdatedAt"),
        "DeletedAt",
        meta.merge_json_meta(F.col("_saved"), patch).alias("AnalysisJson"),
    )
    return records, judged.where(F.col("error").isNotNull()).select(*commands.columns, "error")


def slice_log(log: DataFrame, slices: int | None = None) -> DataFrame:
    """Adds ``slice``: 0, 1, ... along (ts, seq), with about equally many rows each.

    As many slices as the log needs: a slice of ``SLICE_ROWS`` stays a slice of
    that size however long the log is, and whether or not all times are equal.
    """
    if slices is None:
        slices = max(1, math.ceil(log.count() / SLICE_ROWS))
    if slices == 1:
        return log.withColumn("slice", F.lit(0))
    return log.repartitionByRange(slices, "ts", "seq").withColumn("slice", F.spark_partition_id())


def _pieces(log: DataFrame, days: int) -> DataFrame:
    """One row per record and slice.

    ``whole`` sums up all its commands, ``fresh`` only those after its first
    save: the first is for records saved in an earlier slice.
    """
    at = F.struct("ts", "seq")
    narrow = log.select("Id", "slice", "cmd", at.alias("at"))
    piece = Window.partitionBy("Id", "slice")
    all_of = piece.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = piece.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # Running aggregates only: a frame that ends unbounded would be read anew for every row.
    later = piece.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    is_restore = F.col("cmd") == "restore"
    rows = narrow.select(
        "Id",
        "slice",
        "cmd",
        "at",
        F.coalesce(F.max(F.col("cmd") == "save").over(earlier), F.lit(False)).alias("live"),
        F.max(F.when(is_restore, F.col("at"))).over(all_of).alias("last_restore"),
        F.min(F.when(is_restore, F.col("at"))).over(later).alias("next_restore"),
    )
    limit = F.make_dt_interval(F.lit(days))
    is_delete = F.col("cmd") == "delete"
    after_restores = F.col("last_restore").isNull() | (F.col("at") > F.col("last_restore"))
    overdue = F.col("next_restore")["ts"] > F.col("at")["ts"] + limit

    def summary(among: Column) -> Column:
        def pick(fn, when: Column) -> Column:
            return fn(F.when(among & when, F.col("at")))

        return F.struct(
            pick(F.min, is_restore).alias("first_restore"),
            pick(F.max, is_restore).alias("last_restore"),
            pick(F.min, is_delete).alias("first_delete"),
            pick(F.min, is_delete & after_restores).alias("open_delete"),
            pick(F.max, F.col("cmd") == "patch").alias("last_patch"),
            F.coalesce(F.max(among & is_delete & overdue), F.lit(False)).alias("swept"),
            F.coalesce(F.max(among & (F.col("cmd") == "purge")), F.lit(False)).alias("purged"),
        )

    return rows.groupBy("Id", "slice").agg(
        F.min(F.when(F.col("cmd") == "save", F.col("at"))).alias("first_save"),
        summary(F.lit(True)).alias("whole"),
        summary(F.col("live")).alias("fresh"),
    )


def _fold_states(pieces: DataFrame, days: int) -> DataFrame:
    """Pieces of a record (at most one per slice) applied in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("slice", "first_save", "whole", "fresh")))
    when_type = pieces.schema["first_save"].dataType
    time_type = when_type["ts"].dataType
    no_time = F.lit(None).cast(time_type)
    limit = F.make_dt_interval(F.lit(days))
    start = F.struct(
        F.lit(False).alias("saved"),
        F.lit(None).cast(when_type).alias("created"),
        F.lit(False).alias("gone"),
        no_time.alias("DeletedAt"),
        no_time.alias("UpdatedAt"),
    )

    def step(acc: Column, piece: Column) -> Column:
        saved = acc["saved"] | piece["first_save"].isNotNull()
        part = F.when(acc["saved"], piece["whole"]).otherwise(piece["fresh"])
        restored = part["first_restore"]
        leads = restored.isNull() | (part["first_delete"] < restored)
        pending = F.coalesce(acc["DeletedAt"], F.when(leads, part["first_delete"]["ts"]))
        overdue = F.coalesce(restored["ts"] > pending + limit, F.lit(False))
        return F.when(
            saved,
            F.struct(
                saved.alias("saved"),
                F.coalesce(acc["created"], piece["first_save"]).alias("created"),
                (acc["gone"] | part["purged"] | part["swept"] | overdue).alias("gone"),
                F.when(restored.isNull(), pending).otherwise(part["open_delete"]["ts"]).alias("DeletedAt"),
                F.greatest(acc["UpdatedAt"], part["last_restore"]["ts"], part["last_patch"]["ts"]).alias("UpdatedAt"),
            ),
        ).otherwise(acc)

    folded = pieces.groupBy("Id").agg(F.aggregate(ordered, start, step).alias("_state"))
    return folded.select("Id", "_state.*")


def _last_values(log: DataFrame) -> DataFrame:
    """``(Id, _values)``: last value of each patched key (one of a short list) with its place in the log."""
    patches = log.where(F.col("cmd") == "patch").select(
        "Id", F.struct("ts", "seq").alias("_at"), F.explode_outer("_body").alias("_key", "_value")
    ).where(F.col("_key").isNotNull())
    last = patches.groupBy("Id", "_key").agg(F.max("_at").alias("_last"), F.max_by("_value", "_at").alias("_value"))
    value = F.struct(F.col("_key").alias("key"), F.col("_value").alias("value"), F.col("_last").alias("at"))
    return last.groupBy("Id").agg(F.collect_list(value).alias("_values"))
