"""Counts of places near lines by strips of tiles, against plain loops and without pairs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.operators import spatial, strips

LINE = "array<struct<x: double, y: double>>"


def plain_distance(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / square)) if square else 0.0
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


@pytest.mark.parametrize("parts", [(1 << 16, 1 << 13), (16, 4)])
def test_counts_against_all_pairs(spark, monkeypatch, parts):
    """Straight, bent, level, upright, null and infinite lines; places that repeat, lie exactly at a radius, or have no number."""
    monkeypatch.setattr(spatial, "TILE_SPOTS", parts[0])
    monkeypatch.setattr(spatial, "TILE_LINES", parts[1])
    rng = random.Random(11)
    lines = [(i, [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(2 + (i % 5 == 0))]) for i in range(40)]
    lines += [(50, [(0.0, 0.0), (0.0, 0.0)]), (51, [(-1.0, 0.5), (1.0, 0.5)]), (52, [(0.5, -1.0), (0.5, 1.0)]), (53, None), (54, [(0.0, 0.0)])]
    lines += [(55, [(0.0, 0.0), (math.inf, 0.0)]), (56, [(90.0, 90.0), (91.0, 90.0)]), (50, [(2.0, 2.0), (2.0, 1.0)])]
    places = [(rng.randrange(3), rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5)) for _ in range(300)] + [(0, 0.5, 0.5)] * 40
    places += [(c, x, y) for c in (0, 1) for x in (-0.5, 0.0, 0.75) for y in (-0.5, 0.0, 1.0)] + [(0, None, 1.0), (1, math.nan, 0.0), (1, math.inf, 0.0), (None, 0.0, 0.0)]
    a = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p] if p else None) for i, p in lines], f"seg int, line {LINE}")
    b = spark.createDataFrame(places, "c int, x double, y double")
    got = spatial.category_counts(a, b, "seg", "c", [0, 1], [0.25, 0.5, 1.5], unit=100).collect()
    assert len(got) == len(lines)
    for row in got:
        for c in (0, 1):
            for r in (0.25, 0.5, 1.5):
                near = sum(
                    min(plain_distance(x, y, *e) for e in zip(p, p[1:], strict=False)) <= r
                    for i, p in lines if i == row["seg"] and p and len(p) > 1 and math.isfinite(p[1][0])
                    for k, x, y in places if k == c and x is not None and math.isfinite(x)
                )
                assert (row[f"poi_{c}_count_{100 * r:g}m"], row[f"poi_{c}_present_{100 * r:g}m"]) == (near, near > 0)


def test_dense_places_are_not_paired(spark):
    """40 000 lines among 100 000 places that share a tile: 4 * 10^9 pairs, of which almost all are counted by ranges."""
    places = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("c"), (F.pmod(F.col("id") * 7919, F.lit(100_003)) / 100_003).alias("x"), (F.col("id") / 100_000).alias("y"))
    x, y = F.col("id") / 40_000, F.pmod(F.col("id") * 7907, F.lit(39_989)) / 39_989
    ends = [F.struct(x.alias("x"), y.alias("y")), F.struct((x + 0.25 * y).alias("x"), (1 - y).alias("y"))]
    lines = spark.range(40_000).select(F.col("id").alias("seg"), F.array(*ends).alias("line"))
    start = time.monotonic()
    got = {r["seg"]: r for r in spatial.category_counts(lines, places, "seg", "c", [0, 1], [1.0, 0.25], unit=100).collect()}
    assert time.monotonic() - start < 100 and len(got) == 40_000
    c, px, py = (np.array(v) for v in zip(*places.collect(), strict=True))
    for r in lines.where("seg % 2003 = 0").collect():
        d = strips.distances(px, py, *[p[axis] for p in r["line"] for axis in "xy"])
        for k in (0, 1):
            assert [got[r["seg"]][f"poi_{k}_count_{m}m"] for m in (100, 25)] == [int(((c == k) & (d <= m)).sum()) for m in (1.0, 0.25)]
