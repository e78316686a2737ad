"""Toxicity scores: a plain forward pass, few and contradicting labels, long, repeated and clashing rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm.toxicity import BUCKETS, LEAST_SLOPE, SIZES, WINDOW, calibrated, fit, score_toxicity, train_toxicity


def sample(n, toxic_every, seed=1):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [f"{rng.choice(['ther', 'on', 'esh', 'ble'])}{rng.choice(['an', 'wh', 'ing'])}" for _ in range(rng.randrange(5, 40))]
        if i % toxic_every == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["slimeball", "rotbrain"], k=3)
        texts.append(" ".join(words))
    return texts, [int(i % toxic_every == 0) for i in range(n)]


def bucket(gram: bytes) -> int:
    h = 0
    for byte in gram:
        h = (h * 0x100000001B3 + byte) % 2**64
    return (h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> 48


def plain_score(model, text):
    weights = []
    for word in (text or "").lower().split():
        raw = b"<" + word.encode() + b">"
        grams = [raw[i : i + n] for n in SIZES for i in range(len(raw) - n + 1)]
        weights.append(sum(model.weight[bucket(g)] for g in grams) / max(1, len(grams)))
    windows = [sum(weights[i : i + WINDOW]) / WINDOW for i in range(max(1, len(weights) - WINDOW + 1))]
    return 1 / (1 + math.exp(-(model.slope * (model.bias + max(0.0, *windows, 0.0)) + model.shift)))


def test_scores_equal_a_plain_forward_pass():
    assert BUCKETS == 1 << 16
    texts, labels = sample(120, 3)
    model = fit(texts, labels)
    some = [*texts[:30], "", "   ", "a", "Slimeball ROTBRAIN straße 日本", "x " * 500, None]
    assert np.allclose(model.score(some), [plain_score(model, t) for t in some], atol=1e-9)


@pytest.mark.parametrize("n", (2, 5, 12, 47))
def test_few_labels_still_rank(n):
    texts, labels = sample(n, 4)
    model = fit(texts, labels)
    score = model.score(["slimeball rotbrain slimeball on esh", "on esh ble ther"])
    assert model.slope > 0 and score[0] > score[1]
    of, y = model.score(texts), np.array(labels)
    assert of[y == 1].min() > of[y == 0].max()


def test_contradicting_labels_keep_a_positive_slope():
    texts, labels = sample(40, 2)
    model = fit(texts + texts, labels + [1 - y for y in labels])
    assert model.slope > 0 and np.isfinite(model.shift)
    rng = np.random.default_rng(0)
    y = (rng.random(200) < 0.3).astype(int)
    assert calibrated(-2.0 * y + rng.normal(0, 0.1, 200), y)[0] == LEAST_SLOPE


def test_long_repeated_and_clashing_rows(spark):
    texts, labels = sample(90, 3)
    long = "on esh " * 30_000 + "slimeball rotbrain slimeball " + "ble an " * 10
    rows = [(i, t, 9.0) for i, t in enumerate(texts)] + [(0, texts[0], 9.0), (500, long, 9.0), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    known = docs.where("doc_id < 90").withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    scored = score_toxicity(docs, train_toxicity(known.unionByName(known)))
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == 93
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got[500] >= 0.7 and got[None] < 0.3 and got[0] >= 0.7
