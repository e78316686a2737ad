"""Resampling sorts readings, not the grid that it makes of them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_dense_places import newest_stage, task_peak

from curbflow.operators import timeseries


@pytest.mark.parametrize("monthly", (False, True))
def test_against_plain_loops(spark, monkeypatch, monthly):
    """Null readings, ties, readings on a label and after the last one, and stretches longer than an array."""
    monkeypatch.setattr(timeseries, "STRETCH", 7)
    rng = random.Random(4)
    start = datetime(2022, 1, 28)
    rows = [(k, start + timedelta(minutes=rng.choice((7, 30, 60)) * rng.randrange(300)), rng.choice((None, 1, 2, 3))) for k in (1, 2) for _ in range(60)]
    rows += [(3, start + timedelta(seconds=53), 4), (4, start, None), (4, start + timedelta(hours=5), 6), (None, start, 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, v int")
    got = sorted(timeseries.resample_ffill(df, "id", "ts", "v", 3600, reset_monthly=monthly).collect())
    want, groups = [], {}
    for k, t, v in rows:
        if k is not None and t is not None:
            groups.setdefault((k, t.month if monthly else 0), []).append((t, v))
    for (k, _), mine in groups.items():
        label, high = (f(t for t, _ in mine).replace(minute=0, second=0) for f in (min, max))
        while label <= high:
            known = [r for r in mine if r[0] <= label and r[1] is not None]
            want.append((k, label, max(known)[1] if known else None))
            label += timedelta(hours=1)
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: r[:2])


def test_memory_of_a_task(spark):
    """2000 keys with two readings that are 2000 steps apart: four million labels, none of which is sorted."""
    times = F.timestamp_seconds(F.lit(1_640_995_200) + (F.col("id") % 2) * 2000 * 300).cast("timestamp_ntz")
    df = spark.range(4000).select(F.floor(F.col("id") / 2).alias("k"), times.alias("t"), F.col("id").alias("v"))
    since = newest_stage(spark) + 1
    assert timeseries.resample_ffill(df, "k", "t", "v").agg(F.count("*"), F.count("v")).first() == (4_002_000, 4_002_000)
    assert task_peak(spark, since) < 50e6
