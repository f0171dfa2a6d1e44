"""Requests per key and window, above a limit.

The limiter opens a key's window at its first request; the first request that
comes when the window is over opens the next. So where a window begins depends on
all before it. A key's sorted requests are cut into slices; in a slice each
request points to the first one after the window it would open, and doubling the
pointers gives the last window that would begin in the slice. What a slice makes
of the end of the window before it is a short step function; a key's functions
are applied one after the other, and then every slice knows its windows. A key
that sends a third of all requests is many slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill import fixed_values as V
from lexmill.functions.falsy import blank_to_null
from lexmill.session import shared_dir

STEPS = "key string, slice int, entries array<bigint>, exits array<bigint>"
COUNTS = "key string, start bigint, n bigint"
FOUND = "key string, window_start timestamp, n bigint"
STATE = "start bigint, n bigint, waiting binary"


def limiter_key(user: Column, ip: Column) -> Column:
    """The user, or the address when there is none (null, "" and 0 count as none)."""
    known = blank_to_null(user.cast("string"))
    return F.coalesce(F.when(known != "0", known), ip)


def rate_limit_violations(
    requests: DataFrame,
    limit: int = V.RATE_LIMIT,
    width: str = V.RATE_WINDOW,
    ts: str = "ts",
    user: str = "user_id",
    ip: str = "ip",
    delay: str = "2 minutes",
    aligned: bool = False,
) -> DataFrame:
    """``(key, window_start, n)`` of windows with more than ``limit`` requests, batch and stream alike.

    A window opens with a request and holds what comes in less than ``width``. Rows
    without a time or a key are left out. A stream applies a request once the
    watermark has passed it, ``delay`` behind the newest, and gives a window anew
    whenever its count grows. ``aligned`` takes the clock's windows instead.
    """
    keyed = requests.select(F.col(ts).cast("timestamp").alias("ts"), limiter_key(F.col(user), F.col(ip)).alias("key"))
    if aligned:
        keyed = keyed.withWatermark("ts", delay) if requests.isStreaming else keyed
        counted = keyed.groupBy(F.window("ts", width).alias("span"), "key").agg(F.count("*").alias("n"))
        return counted.where(F.col("n") > limit).select("key", F.col("span.start").alias("window_start"), "n")
    span = pd.Timedelta(width).value // 1000
    keyed = keyed.where(F.col("ts").isNotNull() & F.col("key").isNotNull()).withColumn("at", F.unix_micros("ts"))
    if requests.isStreaming:
        return _streamed(keyed, limit, span, delay)
    counted = _windows(keyed.select("key", "at"), span).groupBy("key", "start").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > limit).select("key", F.timestamp_micros("start").alias("window_start"), "n")


def following(at: np.ndarray, span: int) -> np.ndarray:
    """For each of the sorted times the place of the first one that its window does not hold."""
    return np.searchsorted(at, at + span, side="left")


def last_starts(at: np.ndarray, span: int) -> np.ndarray:
    """For each request the last window's start if it opens one; pointers are doubled until none moves."""
    jump = np.append(following(at, span), len(at))
    last = np.arange(len(at) + 1)
    while True:
        moved = jump[last]
        moved = np.where(moved == len(at), last, moved)
        if (moved == last).all():
            return at[last[:-1]]
        last = moved
        jump = np.where(jump[jump] == len(at), jump, jump[jump])


def slice_steps(at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice as a step function: if a window ends at up to ``entries[i]``, the last window starts at ``exits[i]``.

    A window from before ends ``span`` after the slice begins at the latest, so the
    requests up to the first one from there on are all that can open the next.
    Beyond the last entry no window begins here. ``exits`` grows with ``entries``.
    """
    near = at[: np.searchsorted(at, at[0] + span, side="left") + 1]
    ends = last_starts(at, span)[: len(near)]
    steps = np.append(ends[1:] != ends[:-1], True)
    return near[steps], ends[steps]


def count_windows(at: np.ndarray, span: int, ends: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and counts of sorted times; ``ends`` is where the window from before is over."""
    first = 0 if ends is None else int(np.searchsorted(at, ends, side="left"))
    jump, starts = following(at, span), []
    while first < len(at):
        starts.append(first)
        first = int(jump[first])
    counts = np.diff([*starts, len(at)])
    lead = starts[0] if starts else len(at)
    if ends is None or not lead:
        return at[starts], counts
    return np.append(ends - span, at[starts]), np.append(lead, counts)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ()) -> Iterator[tuple[str, int, tuple, np.ndarray]]:
    """``(key, slice, values of names, times)`` of sorted rows, one key's part of a slice at a time."""
    now, held = None, []
    for batch in batches:
        at = batch.column("at").to_numpy()
        rows = list(zip(*(batch.column(n).to_pylist() for n in ("key", "slice", *names)), strict=True))
        first = 0
        for i, row in enumerate(rows):
            if row != now:
                if i > first:
                    held.append(at[first:i])
                if now is not None:
                    yield now[0], now[1], now[2:], np.concatenate(held)
                now, held, first = row, [], i
        held.append(at[first:])
    if now is not None:
        yield now[0], now[1], now[2:], np.concatenate(held)


def _windows(requests: DataFrame, span: int) -> DataFrame:
    """``(key, start, n)``: the windows of each slice; one that goes on in the next slice is two rows."""
    shared_dir(requests.sparkSession)
    tied = requests.withColumn("_row", F.monotonically_increasing_id())  # equal times can be cut apart too
    ordered = tied.sort("key", "at", "_row").drop("_row").checkpoint(eager=True).withColumn("slice", F.spark_partition_id())

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for key, place, _, at in _runs(batches):
            entries, exits = slice_steps(at, span)
            held.append((key, place, entries.tolist(), exits.tolist()))
        yield _batch(held, [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())], ["key", "slice", "entries", "exits"])

    # Only a key that is in more than one slice has to know what came before: one row per slice and such key.
    parts = ordered.mapInArrow(steps, STEPS)
    several = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slice", "entries", "exits"))).alias("parts")).where(F.size("parts") > 1)
    none = F.lit(None).cast("bigint")
    begin = F.struct(none.alias("ends"), F.array().cast("array<struct<slice:int,ends:bigint>>").alias("known"))

    def apply(state: Column, part: Column) -> Column:
        at = F.when(state["ends"].isNull(), F.lit(0)).otherwise(F.size(F.filter(part["entries"], lambda e: e < state["ends"])))
        reached = F.get(part["exits"], at)
        ends = F.coalesce(reached + span, state["ends"])
        return F.struct(ends.alias("ends"), F.concat(state["known"], F.array(F.struct(part["slice"].alias("slice"), state["ends"].alias("ends")))).alias("known"))

    chained = several.select("key", F.explode(F.aggregate("parts", begin, apply)["known"]).alias("k")).select("key", "k.slice", "k.ends")
    known = ordered.join(chained.where("ends is not null"), ["key", "slice"], "left").sortWithinPartitions("key", "slice", "at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for key, _, (ends,), at in _runs(batches, ("ends",)):
            starts, counts = count_windows(at, span, ends)
            held += [(key, s, n) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            if len(held) > 10_000:
                yield _batch(held, [pa.string(), pa.int64(), pa.int64()], ["key", "start", "n"])
                held = []
        yield _batch(held, [pa.string(), pa.int64(), pa.int64()], ["key", "start", "n"])

    return known.select("key", "slice", "ends", "at").mapInArrow(count, COUNTS)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _streamed(keyed: DataFrame, limit: int, span: int, delay: str) -> DataFrame:
    """State of a key: its open window, and the times that wait for the watermark. It is removed when the window is over."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, waiting = state.get if state.exists else (None, 0, b"")
        times = np.sort(np.concatenate([np.frombuffer(waiting, dtype=np.int64), *(b["at"].to_numpy(np.int64) for b in batches)]))
        mark = state.getCurrentWatermarkMs() * 1000
        due, times = times[times <= mark], times[times > mark]
        if len(due):
            starts, counts = count_windows(due, span, None if start is None else start + span)
            if len(starts) and starts[0] == start:
                counts = np.append(counts[0] + n, counts[1:])
            start, n = int(starts[-1]), int(counts[-1])
            over = counts > limit
            if over.any():
                yield pd.DataFrame({"key": key[0], "window_start": pd.to_datetime(starts[over], unit="us"), "n": counts[over]})
        if not len(times) and (start is None or start + span <= mark):
            state.remove()
            return
        state.update((start, n, times.tobytes()))
        wake = int(times[0]) if len(times) else start + span
        state.setTimeoutTimestamp(max(wake // 1000 + 1, mark // 1000 + 1))

    # A watermark counts whole milliseconds: the next one passes every request of this one.
    late = F.timestamp_micros(F.col("at") + 1000)
    rows = keyed.withColumn("ts", late).withWatermark("ts", delay).select("key", "at", "ts")
    return rows.groupBy("key").applyInPandasWithState(update, FOUND, STATE, "update", GroupStateTimeout.EventTimeTimeout)
