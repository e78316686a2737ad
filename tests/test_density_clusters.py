"""Density clusters by a graph of cells, against plain loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curbflow.operators import spatial


def plain_clusters(rows, eps, min_samples):
    near = {k: [j for j, u, v in rows if math.hypot(x - u, y - v) <= eps] for k, x, y in rows}
    cores = {k for k in near if len(near[k]) >= min_samples}
    label = {}
    for k in sorted(cores):
        if k in label:
            continue
        stack = [k]
        label[k] = k
        while stack:
            for j in near[stack.pop()]:
                if j in cores and j not in label:
                    label[j] = k
                    stack.append(j)
    number = {k: i for i, k in enumerate(sorted(set(label.values())))}
    border = {k: min((label[j] for j in near[k] if j in cores), default=None) for k in near if k not in cores}
    return {k: number.get(label.get(k, border.get(k)), -1) for k in near}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


@pytest.mark.parametrize(("eps", "min_samples", "direct"), [(1.0, 4, 4096), (1.0, 4, 3), (0.35, 1, 8), (2.5, 9, 16)])
def test_against_all_pairs(spark, eps, min_samples, direct):
    rng = random.Random(3)
    rows = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(120)]
    for cx, cy, n in ((0, 0, 60), (4, 4, 40), (5.2, 4.1, 30)):
        rows += [(cx + rng.gauss(0, 0.3), cy + rng.gauss(0, 0.3)) for _ in range(n)]
    rows += [(-7.0, 7.0)] * 12 + [(-7.0 + eps, 7.0)] * 3 + [(-7.0, 7.0 - eps * 1.0001)] * 3
    ids = rng.sample(range(1000), len(rows))
    rows = [(i, x, y) for i, (x, y) in zip(ids, rows, strict=True)]
    got = spatial.density_clusters(frame(spark, rows).repartition(5), "id", eps, min_samples, direct=direct)
    assert {r["id"]: r["cluster"] for r in got.collect()} == plain_clusters(rows, eps, min_samples)


def test_gaps_about_the_radius(spark):
    """Dense walls on both sides of a gap: cells are cut until a pair is found or none is left."""
    rng = random.Random(5)
    for gap, clusters in ((0.999, 1), (1.001, 2)):
        rows = [(i, -rng.random() ** 4 * 0.3, i / 800) for i in range(400)] + [(i + 400, gap + rng.random() ** 4 * 0.3, i / 800) for i in range(400)]
        rows += [(800, 0.0, 0.25), (801, gap, 0.25)]
        got = spatial.density_clusters(frame(spark, rows), "id", 1.0, 5, direct=10)
        assert got.select("cluster").distinct().count() == clusters
        assert {r["id"]: r["cluster"] for r in got.collect()} == plain_clusters(rows, 1.0, 5)


def test_many_points_in_one_cell(spark):
    n = 100_000
    spots = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 2e5).alias("x"), (F.pmod(F.hash("id"), F.lit(99_991)) / 2e5).alias("y"))
    twins = spark.range(n, 2 * n).select("id", F.lit(1.3).alias("x"), F.lit(0.2).alias("y"))
    far = spark.range(2 * n, 2 * n + 3).select("id", F.lit(50.0).alias("x"), F.col("id").cast("double").alias("y"))
    got = spatial.density_clusters(spots.union(twins).union(far), "id", 1.0, 10)
    assert {r["cluster"]: r["count"] for r in got.groupBy("cluster").count().collect()} == {0: 2 * n, -1: 3}


def test_rows_without_a_place_or_key(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (None, 0.0, 0.0), (3, nan, 0.0), (4, None, 1.0), (5, inf, 0.0), (None, 5.0, 5.0)]
    got = spatial.density_clusters(frame(spark, rows), "id", 1.0, 2).collect()
    assert sorted((r["id"] or 0, r["cluster"]) for r in got) == [(0, -1), (0, 0), (1, 0), (2, 0), (3, -1), (4, -1), (5, -1)]
    assert spatial.density_clusters(frame(spark, []), "id", 1.0, 2).collect() == []


def broadcasts(spark) -> int:
    """Broadcasts in the plans of all executions of the session so far."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, n = store.executionsList().iterator(), 0
    while runs.hasNext():
        nodes = store.planGraph(runs.next().executionId()).allNodes().iterator()
        while nodes.hasNext():
            n += nodes.next().name() == "BroadcastExchange"
    return n


def test_joins_stay_away_from_the_driver(spark):
    """Only the offsets of a layout's partitions are broadcast, in however many rounds the clusters settle."""
    chain = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 0.9).alias("x"), F.lit(0.0).alias("y"))
    before = broadcasts(spark)
    assert spatial.density_clusters(chain, "k", 1.0, 3).where("cluster = 0").count() == 400
    assert broadcasts(spark) - before <= 1
