"""Pairs of lines and places of full cells go to many tasks; neighbours are counted without their pairs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from curbflow.operators import spatial

LINE = "array<struct<x: double, y: double>>"


def plain_distance(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / square)) if square else 0.0
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


@pytest.mark.parametrize("few_tiles", [200_000, 0])
def test_pairs_of_parts_against_all_pairs(spark, monkeypatch, few_tiles):
    """Straight, bent, upright, null and pointlike lines and places that repeat or have no number, in the smallest parts."""
    monkeypatch.setattr(spatial, "TILE_SPOTS", 16, raising=False)
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 64, raising=False)
    monkeypatch.setattr(spatial, "FEW_TILES", few_tiles, raising=False)
    rng = random.Random(5)
    lines = [(i, [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(2 + (i % 5 == 0))]) for i in range(40)]
    lines += [(50, [(0.0, 0.0), (0.0, 0.0)]), (51, [(0.5, -1.0), (0.5, 1.0)]), (52, None), (53, [(0.0, 0.0)]), (51, [(0.5, -1.0), (0.5, 1.0)])]
    places = [(i, rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5)) for i in range(200)] + [(300, 0.5, 0.5)] * 40
    places += [(301, 1.25, 0.0), (302, None, 1.0), (303, math.nan, 0.0), (304, math.inf, 0.0)]
    a = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p] if p else None) for i, p in lines], f"seg int, line {LINE}")
    b = spark.createDataFrame(places, "place int, x double, y double")
    got = sorted((r["seg"], r["place"], round(r["distance"], 9)) for r in spatial.pairs_within(a, b, 0.75).collect())
    want = []
    for seg, p in lines:
        for place, x, y in places:
            if p and len(p) > 1 and x is not None and math.isfinite(x):
                d = min(plain_distance(x, y, *e) for e in zip(p, p[1:], strict=False))
                want += [(seg, place, round(d, 9))] if d <= 0.75 else []
    assert got == sorted(want) and len(got) > 1000


def test_pairs_of_one_cell_are_not_one_task(spark, monkeypatch):
    """3000 lines and 3000 places of one cell: no task makes half of the 9 million pairs, and none of them costs a function of arrays."""
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 1 << 16, raising=False)
    x, y = F.col("id") / 30_000 + 0.1, F.pmod(F.col("id") * 7907, F.lit(3001)) / 30_010 + 0.1
    places = spark.range(3000).select(F.col("id").alias("place"), x.alias("x"), y.alias("y"))
    lines = spark.range(3000).select(F.col("id").alias("seg"), F.array(F.struct(x.alias("x"), y.alias("y")), F.struct(y.alias("x"), x.alias("y"))).alias("line"))
    near = spatial.pairs_within(lines, places, 1.0).select("seg", "place")
    by_task = [r["count"] for r in near.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == 9_000_000 and max(by_task) < 4_500_000
    assert "array_position" not in near._jdf.queryExecution().executedPlan().toString()


def test_others_within_against_all_pairs(spark):
    """Places that repeat, share a key, lie exactly at the radius or have no number or key."""
    rng = random.Random(3)
    rows = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(200)] + [(300, 0.5, 0.5), (301, 0.5, 0.5), (302, 0.25, 0.5), (300, 0.5, 0.75)]
    rows += [(303, 90.0, 90.0), (304, None, 1.0), (305, math.nan, 0.0), (306, math.inf, 0.0), (None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = {r["id"]: r["n"] for r in spatial.others_within(df, "id", 0.25).collect()}
    want = {}
    for a, x, y in rows:
        far = x is None or a is None or not math.isfinite(x)
        near = 0 if far else sum(b not in (a, None) and u is not None and math.isfinite(u) and math.hypot(x - u, y - v) <= 0.25 for b, u, v in rows)
        want[a] = want.get(a, 0) + near
    assert got == want


def test_others_of_dense_places_are_not_paired(spark):
    """100 000 places within one radius: 10^10 pairs."""
    places = spark.range(100_000).select("id", (F.pmod(F.col("id") * 7919, F.lit(100_003)) / 100_003).alias("x"), (F.col("id") / 100_000).alias("y"))
    start = time.monotonic()
    got = spatial.others_within(places, "id", 2.0).groupBy("n").count().collect()
    assert [tuple(r) for r in got] == [(99_999, 100_000)] and time.monotonic() - start < 100
