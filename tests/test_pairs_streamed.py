"""Pairs of lines and places leave their groups in blocks; what is shuffled for them grows with the rows, not with the pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dense_pairs import plain_distance
from test_dense_places import newest_stage

from curbflow.operators import spatial


def rows_shuffled(spark, since: int) -> int:
    """Rows that the stages from the given id on wrote for shuffles."""
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm
    stages = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        stage = stages.next()
        total += stage.shuffleWriteRecords() if stage.stageId() >= since else 0
    return total


def test_what_is_shuffled_grows_as_the_rows(spark, monkeypatch):
    """n lines and n places of one full cell, none near another: four times the rows are sixteen times the pairs, and four times what is shuffled."""
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 1 << 16)
    shuffled = []
    for n in (2000, 8000):
        at = (F.col("id") / n / 100).alias("x"), (F.pmod(F.col("id") * 7907, F.lit(n)) / n / 100).alias("y")
        ends = [F.struct((at[0] + d).alias("x"), at[1].alias("y")) for d in (0, 0.001)]
        lines = spark.range(n).select(F.col("id").alias("seg"), F.array(*ends).alias("line"))
        places = spark.range(n).select(F.col("id").alias("place"), (at[0] + 0.98).alias("x"), (at[1] + 0.98).alias("y"))
        since = newest_stage(spark) + 1
        assert spatial.pairs_within(lines, places, 1.0).count() == 0
        shuffled.append(rows_shuffled(spark, since))
    assert shuffled[1] <= 5 * shuffled[0]


@pytest.mark.parametrize("shift", [0.0, 4.6e6])
def test_blocks_of_cells_against_all_pairs(monkeypatch, shift):
    """Cells of few places, blocks smaller than a cell; level, upright and pointlike edges, places that repeat; metres far from the origin."""
    from curbflow.operators import cells

    monkeypatch.setattr(cells, "BLOCK", 64)
    monkeypatch.setattr(cells, "CELL_PLACES", 4)
    rng = np.random.default_rng(7)
    at = np.concatenate([rng.uniform(-2, 2, (300, 2)), np.full((100, 2), 0.5), rng.integers(-2, 3, (60, 2)) / 2]) + shift
    ends = np.concatenate([rng.uniform(-3, 3, (60, 4)), [[0.5, -1, 0.5, 1], [-1, 0.5, 1, 0.5], [0.5, 0.5, 0.5, 0.5], [9, 9, 10, 10]]]) + shift
    for radius in (0.5, 0.03125):
        blocks = list(cells.Cells(*at.T).near(ends, radius))
        assert all(len(edge) <= 64 for edge, _, _ in blocks)
        got = sorted((int(e), int(p), float(d)) for block in blocks for e, p, d in zip(*block, strict=True))
        want = {(e, p): plain_distance(x, y, (ax, ay), (bx, by)) for e, (ax, ay, bx, by) in enumerate(ends) for p, (x, y) in enumerate(at)}
        near = sorted((k for k, d in want.items() if d <= radius - 1e-9))
        found = {(e, p): d for e, p, d in got}
        assert len(found) == len(got) and set(near) <= set(found)
        assert all(want[k] <= radius + 1e-9 and math.isclose(want[k], d, abs_tol=1e-8) for k, d in found.items())
    assert not list(cells.Cells(np.zeros(9), np.zeros(9)).near(np.array([[1.0, 1.0, 2.0, 2.0]]), 0.5))


def test_kept_columns_and_rounding(spark):
    """Text and null columns of both sides, distances rounded upwards at half, a bent line's pair once, vertices and lines without numbers."""
    def line(*xy):
        return [{"x": x, "y": y} for x, y in xy]

    lines = [("a", None, line((0.0, 0.0), (4.0, 0.0))), (None, 1, line((0.0, 1.0), (2.0, 1.0), (2.0, 3.0))), ("c", 2, line((0.0, 0.0), (math.inf, 0.0))), ("d", 3, line((0.0, 5.0), (1.0, 5.0), (math.nan, 0.0), (None, 0.0)))]
    places = [("p", 1.0, 0.125, 7), (None, 2.0, 1.0, None), ("q", 1.0, 5.25, 9), ("r", None, 0.0, 1), ("s", math.inf, 0.0, 1)]
    a = spark.createDataFrame(lines, "seg string, no int, line array<struct<x: double, y: double>>")
    b = spark.createDataFrame(places, "place string, x double, y double, kind long")
    got = spatial.pairs_within(a, b, 1.0, ["seg", "no", "place", "kind"], decimals=2)
    assert got.columns == ["seg", "no", "place", "kind", "distance"]
    want = [("a", None, "p", 7, 0.13), ("a", None, None, None, 1.0), (None, 1, "p", 7, 0.88), (None, 1, None, None, 0.0), ("d", 3, "q", 9, 0.25)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert spatial.pairs_within(a, b.where("false"), 1.0).count() == 0
