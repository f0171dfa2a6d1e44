"""Windows that a key's first request opens: slices against a plain walk, batch and stream."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from lexmill.streaming import rate_limit as R

START = datetime(2024, 1, 1)


def walked(times, span):
    """``{window start: requests}`` one request after the other."""
    out, start = Counter(), None
    for at in sorted(times):
        if start is None or at >= start + span:
            start = at
        out[start] += 1
    return out


def test_slices_compose():
    rng = random.Random(1)
    for _ in range(400):
        times = sorted(rng.choices(range(rng.choice([20, 200, 3000])), k=rng.randrange(1, 60)))
        span = rng.choice([1, 7, 60])
        cuts = sorted(rng.sample(range(1, len(times)), min(len(times) - 1, rng.randrange(5)))) if len(times) > 1 else []
        slices = [np.array(times[a:b]) for a, b in zip([0, *cuts], [*cuts, len(times)], strict=True)]
        ends, found = None, Counter()
        for at in slices:
            for start, n in zip(*R.count_windows(at, span, ends), strict=True):
                found[int(start)] += int(n)
            entries, exits = R.slice_steps(at, span)
            step = 0 if ends is None else int((entries < ends).sum())
            ends = int(exits[step]) + span if step < len(exits) else ends
        assert found == walked(times, span)


def asked(rng, n):
    """A key with a third of all requests, some at one time; keys by address; rows without a time."""
    keys = [(1, "a")] * (n // 3) + [(rng.randrange(2, 9), "a") for _ in range(n // 2)] + [(0, "b"), (None, "c")] * 20
    rows = [(START + timedelta(milliseconds=rng.randrange(400_000)), *key) for key in keys]
    return rows + [(START + timedelta(seconds=30), 1, "a")] * 40 + [(None, 1, "a"), (START, None, None)]


def plain(rows, limit):
    times = {}
    for at, user, ip in rows:
        key = str(user) if user else ip
        if at is not None and key is not None:
            times.setdefault(key, []).append((at - START) // timedelta(microseconds=1))
    counts = {(key, start): n for key, own in times.items() for start, n in walked(own, 60_000_000).items()}
    return {(key, START + timedelta(microseconds=start), n) for (key, start), n in counts.items() if n > limit}


SCHEMA = "ts timestamp, user_id int, ip string"


@pytest.mark.parametrize("merge", ["true", "false"])
def test_batch(spark, merge):
    rows = asked(random.Random(3), 900)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    try:
        found = R.rate_limit_violations(spark.createDataFrame(rows, SCHEMA), 10).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in found} == plain(rows, 10) and len(found) > 5
    assert R.rate_limit_violations(spark.createDataFrame([], SCHEMA), 10).collect() == []


def test_stream_out_of_order_and_restarted(spark, tmp_path):
    """Files arrive one by one, requests up to half a minute late; each run goes on from the checkpoint."""
    rng = random.Random(4)
    rows = [r for r in asked(rng, 300) if r[0] is not None]
    rows.sort(key=lambda r: r[0] + timedelta(seconds=rng.randrange(25)))
    rows.append((START + timedelta(days=1), 99, "z"))  # moves the watermark past all others
    best = {}
    for n in range(4):
        part = rows[n * len(rows) // 4 : (n + 1) * len(rows) // 4]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = R.rate_limit_violations(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 10, delay="30 seconds")
        out = str(tmp_path / f"out{n}")

        def store(batch, epoch, out=out):
            batch.write.mode("append").parquet(out)

        stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for r in spark.read.schema(R.FOUND).parquet(out).collect():
            best[r.key, r.window_start] = max(r.n, best.get((r.key, r.window_start), 0))
    assert {(k, s, n) for (k, s), n in best.items()} == plain(rows, 10)
