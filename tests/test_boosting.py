"""Boosted trees against plain sums, against a forest, and in their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.operators.boosting import boosted_trees

ALL = {"feature_fraction": 1.0, "row_fraction": 1.0}


def rings(spark, n, parts=4):
    """Three labels by the distance from a centre, a tenth of them wrong; a column without meaning, and nulls."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-2, 2), rng.uniform(-2, 2)
        name = "far" if math.hypot(x, y) > 1.5 else "mid" if math.hypot(x, y) > 0.8 else "near"
        rows.append((i, x, None if i % 17 == 0 else y, float(i % 5), rng.choice(["far", "mid", "near"]) if rng.random() < 0.1 else name))
    return spark.createDataFrame(rows, "id int, x double, y double, z double, state string").repartition(parts, "id")


def log_loss(said):
    rows = said.select("state", "probability").collect()
    names = ["far", "mid", "near"]
    return -sum(math.log(max(list(r["probability"])[names.index(r["state"])], 1e-15)) for r in rows) / len(rows)


def test_below_a_forest_and_falling(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    df = rings(spark, 3000).withColumns({"valid": F.col("id").between(1800, 2200), "test": F.col("id") > 2200})
    model = boosted_trees(df.where("not test"), ["x", "y", "z"], "state", "valid", rounds=40, rate=0.2, depth=3, patience=5)
    test = df.where("test")
    mine = log_loss(model.predict(test))
    losses = [a for a, _ in model.losses]
    assert all(b < a for a, b in zip(losses[:15], losses[1:16], strict=False))
    held = [b for _, b in model.losses]
    assert len(model.rounds) == int(np.argmin(held)) and len(held) - 1 <= len(model.rounds) + 5
    assert model.gains[:2].min() > 5 * model.gains[2]
    filled = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df.na.fill(0.0))
    filled = StringIndexer(inputCol="state", outputCol="label", stringOrderType="alphabetAsc").fit(filled).transform(filled)
    forest = RandomForestClassifier(numTrees=20, maxDepth=5, seed=42).fit(filled.where("not test and not valid"))
    theirs = log_loss(forest.transform(filled.where("test")).select("state", F.expr("probability").alias("v")).withColumn("probability", as_array("v")).select("state", "probability"))
    assert mine < theirs
    assert mine == pytest.approx(log_loss(model.predict(test.repartition(3))))


def as_array(name):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(name))


def test_first_round_against_plain_sums(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(6)), float(rng.randrange(4)) if rng.random() < 0.9 else None, rng.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, t int")
    found = [boosted_trees(df.repartition(p), ["a", "b"], "t", rounds=1, depth=1, n_bins=8, **ALL) for p in (1, 6)]
    share = [sum(r[2] == k for r in rows) / 400 for k in range(3)]
    for k in range(3):
        options = []
        for j in range(2):
            for cut in [-math.inf, *range(6)]:
                left = [r for r in rows if (-math.inf if r[j] is None else r[j]) <= cut]
                right = [r for r in rows if (-math.inf if r[j] is None else r[j]) > cut]
                g = [sum(share[k] - (r[2] == k) for r in side) for side in (left, right)]
                h = [len(side) * share[k] * (1 - share[k]) for side in (left, right)]
                if min(h) >= 1:
                    whole = sum(g) ** 2 / (sum(h) + 1)
                    options.append((sum(x * x / (y + 1) for x, y in zip(g, h, strict=True)) - whole, [-0.1 * x / (y + 1) for x, y in zip(g, h, strict=True)]))
        best = max(options)
        for model in found:
            assert np.allclose(model.rounds[0].leaf[k], best[1], atol=1e-5)
    assert np.allclose(found[0].gains, found[1].gains)
    assert np.isclose(found[0].losses[0][0], -sum(p * math.log(p) for p in share), atol=1e-6)


def test_balanced_rare_label(spark):
    rows = [(float(i % 10), "rare" if i % 10 == 9 and i % 3 == 0 else "usual") for i in range(600)]
    df = spark.createDataFrame(rows, "a double, t string")
    said = [boosted_trees(df, ["a"], "t", rounds=10, depth=2, balanced=b, **ALL).predict(df) for b in (False, True)]
    assert [s.where("prediction = 'rare'").count() for s in said] == [0, 60]


def test_edges(spark):
    one = spark.createDataFrame([(1.0, 7)] * 5 + [(None, None)], "a double, t int")
    said = boosted_trees(one, ["a"], "t", rounds=2).predict(one).collect()
    assert len(said) == 6 and {r["prediction"] for r in said} == {7}
    with pytest.raises(ValueError):
        boosted_trees(one.where("false"), ["a"], "t")
    nothing = spark.createDataFrame([(None, 1), (None, 2), (None, 2)], "a double, t int")
    assert {r["prediction"] for r in boosted_trees(nothing, ["a"], "t", rounds=2).predict(nothing).collect()} == {2}
    assert boosted_trees(one, ["a"], "t", rounds=1).predict(one.where("false")).collect() == []


def test_reports_of_registered_queries(spark):
    """What is certain of a report: supports are the folds' labels, shares fit each other, and training beats the commonest label."""
    from curbflow.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["pipeline_prediction_features"](spark, sf).select("slot_ts", "key", "slot", "state").collect()
    states = [r["state"] for r in sorted(rows)]
    size = len(states) // 4
    report = QUERIES["pipeline_prediction_report"](spark, sf).collect()
    for fold in (0, 1, 2, None):
        test = states[len(states) - (3 - fold) * size :][:size] if fold is not None else states[len(states) - 3 * size :]
        mine = [r for r in report if r["fold"] == fold]
        assert {r["label"]: r["support"] for r in mine} == {s: test.count(s) for s in set(test)}
        hits = sum(r["recall"] * r["support"] for r in mine)
        assert len(mine) == 3 and all(hits / len(test) == pytest.approx(r["accuracy"]) for r in mine)
        assert mine[0]["accuracy"] > max(r["support"] for r in mine) / len(test) + 0.05
    confusion = QUERIES["ml2_boosted_trees"](spark, "/root/testdata/sf0.01").collect()
    right = sum(r["n"] for r in confusion if r["label"] == r["prediction"])
    assert right > 0.6 * sum(r["n"] for r in confusion)


def test_rows_with_the_same_bins_are_one(spark, monkeypatch):
    """What each pass reads are a few groups, and in them the hash of every row."""
    from curbflow.operators import boosting

    tables = []

    def kept(df):
        tables.append(written(df))
        return tables[-1]

    written = boosting.written
    monkeypatch.setattr(boosting, "written", kept)
    df = spark.range(100_000).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 4 > 1).cast("int").alias("t"))
    model = boosting.boosted_trees(df, ["a", "b"], "t", rounds=1)
    data = tables[0]
    assert data.count() <= 100_000 // boosting.MOST_HASHES + 12 * data.rdd.getNumPartitions()
    assert data.agg(F.sum(F.length("h")), F.max(F.length("h"))).first() == (800_000, 8 * boosting.MOST_HASHES)
    assert model.losses[1][0] < model.losses[0][0] == pytest.approx(0.693147, abs=1e-5)
