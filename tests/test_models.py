"""Lookup baseline, split gains and profiles against plain loops and in their edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from curbflow.operators import models
from curbflow.plans.learning import robust_scaled


def test_lookup_predictions(spark):
    rows = [
        (0, "train", 1, "a"), (0, "train", 1, "b"), (0, "train", 2, "c"), (0, "train", 2, "c"), (0, "train", 2, None), (0, "train", None, "c"),
        (0, "test", 1, "b"), (0, "test", 2, "c"), (0, "test", 3, "a"), (0, "test", None, "a"), (1, "test", 1, "a"),
    ]
    held = spark.createDataFrame(rows, "fold int, part string, key int, label string").withColumnRenamed("label", "state")
    got = {(r["fold"], r["key"]): r["prediction"] for r in models.lookup_predictions(held, ["key"], "state").collect()}
    assert got == {(0, 1): "a", (0, 2): "c", (0, 3): "c", (0, None): "c", (1, 1): None}
    assert models.lookup_predictions(held.limit(0), ["key"], "state").count() == 0


def impurity(labels):
    n = len(labels)
    return 1 - sum((c / n) ** 2 for c in Counter(labels).values()) if n else 0.0


@pytest.mark.parametrize("copies", [1, 5])
def test_split_gains_against_plain_loops(spark, copies):
    rng = random.Random(3)
    edges = [-1.0, -0.5, 0.0, 0.5, 1.0]
    rows = []
    for _ in range(300):
        x = rng.gauss(0, 1)
        rows += [("x", x, int(x > 0.5)), ("noise", rng.gauss(0, 1), int(x > 0.5)), ("step", rng.choice(edges), int(x > 0.5))]
    rows += [("flat", 7.0, i % 2) for i in range(10)]
    odd = [("x", None, 1), ("x", float("nan"), 1), ("x", 0.1, None), ("none", None, 1)]
    df = spark.createDataFrame((rows + odd) * copies, "feature string, value double, label int")
    got = {r["feature"]: (r["edge"], r["gain"]) for r in models.split_gains(df, edges).collect()}
    for name in ("x", "noise", "step"):
        mine = [(v, y) for f, v, y in rows if f == name]
        whole, best = impurity([y for _, y in mine]), (0.0, None)
        for e in edges:
            left, right = [y for v, y in mine if v < e], [y for v, y in mine if v >= e]
            if left and right:
                gain = whole - (len(left) * impurity(left) + len(right) * impurity(right)) / len(mine)
                best = max(best, (gain, e), key=lambda b: b[0] + 1e-12 * (b is best))
        assert got[name][0] == best[1] and got[name][1] == pytest.approx(best[0], abs=1e-9)
    assert got["flat"] == (None, 0.0) and set(got) == {"x", "noise", "step", "flat"}
    assert got["x"][0] == 0.5
    assert models.split_gains(df.limit(0), edges).count() == 0


def test_group_profiles_and_distances(spark):
    rows = [(1, 0.5, 0.5), (1, 0.1, 0.1), (2, 0.2, None), (None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r["g"]: r for r in models.group_profiles(df, "g", ["a", "b"], "top").collect()}
    assert (got[1]["n"], got[1]["top"], got[2]["top"], got[None]["top"]) == (2, 0, 0, 1)
    assert got[1]["a_std"] == pytest.approx(np.std([0.5, 0.1], ddof=1)) and got[2]["a_std"] is None and got[2]["b_mean"] is None
    away = df.where("g = 1 and a = 0.5").select(models.squared_distances(["a", "b"], [[0.5, 0.5], [0.0, 0.5]]).alias("d")).first()["d"]
    assert away == pytest.approx([0.0, 0.25])


def test_robust_scaled_columns(spark):
    rows = [(i, float(i), 5.0, None, i % 2) for i in range(9)] + [(9, None, 5.0, None, 1)]
    df = spark.createDataFrame(rows, "id int, a double, flat double, none double, whole int")
    got = {r["id"]: r for r in robust_scaled(df, ["a", "flat", "none", "whole"]).collect()}
    low, mid, high = np.quantile(np.arange(9.0), [0.25, 0.5, 0.75])
    q = np.quantile([r[4] for r in rows], [0.25, 0.5, 0.75])
    for i, a, _, _, w in rows:
        assert got[i]["a"] == (None if a is None else pytest.approx((a - mid) / (high - low)))
        assert got[i]["flat"] == 0.0 and got[i]["none"] is None
        assert got[i]["whole"] == pytest.approx((w - q[1]) / (q[2] - q[0]))
    assert robust_scaled(df.limit(0), ["a"]).count() == 0
