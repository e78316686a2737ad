"""Hard negatives against plain loops, with small windows, parts and groups of anchors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import hard_negatives as hn
from curbflow.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score long, norm string"


def plain(rows, asked, percent=80, k=5):
    ok = [
        (i, lab, tuple(int(np.floor(256 * x)) for x in v))
        for i, v, lab, *_ in rows
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, lab, v in sorted(ok):
        if asked(i):
            anchors.setdefault(i, (lab, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, lab) for i, lab, v in ok if i != a and len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:k]:
            ps = -ps
            near = [(i, -s) for s, i, lab in scored if lab != label and percent * ps <= -100 * s <= 100 * ps][:k]
            out += [(a, p, r, n, ps, ns) for r, (n, ns) in enumerate(near, 1)]
    return sorted(out)


def some_rows(seed, n=300):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        lab = rng.randrange(4)
        rows.append((i, [c + rng.gauss(0, 0.6) for c in centre[lab]], rng.choice([lab, lab, lab, 1]), 1, 2, "x"))
    rows += [(1000 + i, [0.5, 0.25, 0.5, -0.25, 1.0, 0.0], i % 3, 1, 2, "x") for i in range(90)]  # copies, with ties
    rows += [(2000, None, 1, 1, 2, "x"), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, 2, "x"), (2020, [float("nan")] * 6, 1, 1, 2, "x")]
    rows += [(2030, [float("inf")] * 6, 1, 1, 2, "x"), (2040, [1.0] * 6, None, 1, 2, "x"), (None, [1.0] * 6, 1, 1, 2, "x"), (2050, [], 1, 1, 2, "x")]
    rows += [(2060, [0.0] * 6, 2, 1, 2, "x"), (2070, [1.0, 2.0], 1, 1, 2, "x"), (2071, [1.0, 1.5], 1, 1, 2, "x"), (2072, [1.0, 1.75], 2, 1, 2, "x")]
    rows += [(20, [-1.0] * 6, 0, 1, 2, "x"), (33, rows[33][1], 2, 1, 2, "x"), (33, rows[33][1], 2, 1, 2, "x")]
    rows += [(2080, [-x for x in centre[0]], 9, 1, 2, "x"), (2081, centre[0], 9, 1, 2, "x")]  # the one positive has a negative score
    return rows


@pytest.mark.parametrize("small", (False, True))
def test_against_plain_loops(spark, monkeypatch, small):
    if small:
        for name, value in (("WINDOW", 4), ("PART", 50), ("ANCHORS", 7), ("SAMPLE", 60)):
            monkeypatch.setattr(hn, name, value)
    rows = some_rows(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_nothing_to_do(spark):
    df = spark.createDataFrame(some_rows(1, 20), SCHEMA)
    assert hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    assert hard_negatives(df, F.col("vec_id") == -5, F.col("label")).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    v = np.floor(64 * (centre[rng.integers(12, size=6000)] + rng.normal(0, 0.12, (6000, 16)))).astype(np.int64)
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    angles = hn.angles_to(v, norm, hn.directions(v[:1000].astype(float)))
    order = np.lexsort((angles.min(1), angles.argmin(1)))
    v, norm, angles = v[order], norm[order], angles[order]
    begins = np.arange(0, len(v), 64)
    low, high = hn.score_bounds(angles[::50], norm[::50], *(f(angles, begins) for f in (np.minimum.reduceat, np.maximum.reduceat)), *(f(norm, begins) for f in (np.minimum.reduceat, np.maximum.reduceat)))
    score = v[::50] @ v.T
    assert (np.minimum.reduceat(score, begins, axis=1) >= low).all() and (np.maximum.reduceat(score, begins, axis=1) <= high).all()
    ids, labels = np.arange(len(v)), np.zeros(len(v), np.int64)
    floors = np.full((len(v[::50]), 1), hn.LOWEST)
    cell = hn.Cell(ids[::50], labels[::50], v[::50], norm[::50], angles[::50], floors, np.full_like(floors, hn.HIGHEST), 5, True)
    cell.search(ids, labels, v, norm, angles)
    assert cell.scored < 0.35 * cell.seen  # most windows are never multiplied
    best = np.sort(np.where(ids[::50][:, None] == ids, hn.LOWEST, score), axis=1)[:, :-6:-1]
    assert (cell.lists.score == best).all()


def test_near_right_angles_and_equal_vectors():
    """Rounding can't move a product out of its bounds, however close the angles are."""
    rng = np.random.default_rng(0)
    v = rng.integers(-300, 300, (400, 3))
    v = np.r_[v, v * 7, -v]
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    angles = hn.angles_to(v, norm, hn.directions(v.astype(float), 4))
    low, high = hn.score_bounds(angles, norm, angles, angles, norm, norm)
    score = v @ v.T
    assert (score >= low).all() and (score <= high).all()
