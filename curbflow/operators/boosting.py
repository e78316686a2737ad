"""Boosted trees for several classes: gradients' histograms are summed over partitions, trees are grown on the sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.sources.scratch import written

#: Gradients are summed as whole numbers of 2^-24, so that sums don't depend on the order of partitions.
UNIT = float(1 << 24)
#: More labels than this are an error: the driver holds a histogram for each.
MOST_CLASSES = 256


@dataclass
class Trees:
    """One round: for each class a tree of full depth; a row goes right where its bin is above the threshold."""

    feature: np.ndarray  # class, inner node
    threshold: np.ndarray
    leaf: np.ndarray  # class, leaf


@dataclass
class BoostedModel:
    features: list[str]
    labels: list
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[Trees] = field(default_factory=list)
    gains: np.ndarray | None = None
    losses: list[tuple[float, float]] = field(default_factory=list)  # training, validation; after 0, 1, ... rounds

    def predict(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        """df with the likeliest label (the first of equals in order) and the labels' probabilities."""
        model = self

        @F.pandas_udf("array<double>")
        def of(values: pd.Series) -> pd.Series:
            bins = binned(np.stack(values.to_numpy()).astype(float), model.edges)
            return pd.Series(list(softmax(margins(bins, np.tile(model.base, (len(bins), 1)), model.rounds))))

        found = df.withColumn(probability, of(feature_array(self.features)))
        best = F.array_position(probability, F.array_max(probability)).cast("int")
        return found.withColumn(prediction, F.element_at(F.array(*[F.lit(v) for v in self.labels]), best))

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, gain): the loss that splits on each feature took away."""
        rows = [(name, float(g)) for name, g in zip(self.features, self.gains, strict=True)]
        return spark.createDataFrame(rows, "feature string, gain double")


def feature_array(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin 0 for what is missing, else 1 + the number of edges below the value."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        v = values[:, j]
        out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left"))
    return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def node_of(bins: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Each row's node of the given level."""
    rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    for level in range(levels):
        at = (1 << level) - 1 + node
        node = 2 * node + (bins[rows, feature[at]] > threshold[at])
    return node


def margins(bins: np.ndarray, start: np.ndarray, rounds: list[Trees]) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        levels = int(trees.leaf.shape[1]).bit_length() - 1
        for k in range(out.shape[1]):
            out[:, k] += trees.leaf[k][node_of(bins, trees.feature[k], trees.threshold[k], levels)]
    return out


def values_of(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary rows, and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype), np.diff(at) // size


def matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return values_of(column, dtype)[0].reshape(-1, width)


def binary(values: np.ndarray, starts: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as bytes, or a vector cut at ``starts``."""
    if starts is None:
        starts = np.arange(len(values)) * values.shape[1]
    offsets = (np.append(starts, values.size) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


HISTOGRAM = "slot int, feature int, bin int, g long, h long"
#: A row stands for the rows of one partition with the same label and bins; h holds their hashes, 8 bytes each.
DATA = "y int, w double, valid boolean, h binary, bins binary, margin binary"
#: Rows of a partition that are grouped together, and the most hashes of a group, which bounds what 10 000 groups take.
GROUPED, MOST_HASHES = 1 << 20, 256
#: Groups that are written at once.
WRITTEN = 1 << 13


def same_bins(y: np.ndarray, valid: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order in which rows with the same label and bins are neighbours, and where their groups start in it."""
    key = np.zeros((len(y), -(-(bins.shape[1] + 2) // 8) * 8), np.uint8)
    key[:, 0], key[:, 1], key[:, 2 : 2 + bins.shape[1]] = y, valid, bins
    words = key.view(np.uint64)
    order = np.lexsort(words.T)
    words = words[order]
    new = np.append(True, (words[1:] != words[:-1]).any(axis=1))
    starts = np.flatnonzero(new)
    new |= (np.arange(len(y)) - starts[np.cumsum(new) - 1]) % MOST_HASHES == 0
    return order, np.flatnonzero(new)


def histogram_task(new: list[Trees], now: Trees, level: int, n_bins: int, kept: Callable[[np.ndarray], np.ndarray]):
    """Sums of a partition's gradients by (class and node, feature, bin), and at level 0 of its losses (slot -1)."""
    classes, nodes = now.leaf.shape[0], 1 << level

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = None, np.zeros((2, 2), np.int64)
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            y, w = c["y"].to_numpy(), c["w"].to_numpy()
            valid = c["valid"].to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            h, n = values_of(c["h"], np.int64)
            mine = np.add.reduceat(kept(h).astype(np.int64), np.cumsum(n) - n)
            bins = matrix(c["bins"], np.uint8, len(c["bins"][0].as_py()))
            p = softmax(margins(bins, matrix(c["margin"], np.float64, classes), new))
            if level == 0:
                lost = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * w
                for i, part in enumerate((~valid, valid)):
                    loss[i] += [int((np.rint(v[part] * UNIT) * n[part]).sum()) for v in (lost, w)]
            use = ~valid & (mine > 0)
            y, w, bins, p, mine = y[use], w[use], bins[use], p[use], mine[use]
            if total is None:
                total = np.zeros((classes * nodes, bins.shape[1], n_bins, 2), np.int64)
            for k in range(classes):
                g = np.rint((p[:, k] - (y == k)) * w * UNIT)
                hess = np.rint(p[:, k] * (1 - p[:, k]) * w * UNIT)
                at = node_of(bins, now.feature[k], now.threshold[k], level) * n_bins
                for j in range(bins.shape[1]):
                    for i, v in enumerate((g * mine, hess * mine)):
                        s = np.bincount(at + bins[:, j], v, nodes * n_bins).reshape(nodes, n_bins)
                        total[k * nodes : (k + 1) * nodes, j, :, i] += s.astype(np.int64)
        found = np.empty((0, 3), np.int64) if total is None else np.argwhere(total.any(axis=3))
        sums = np.empty((0, 2), np.int64) if total is None else total[tuple(found.T)]
        if level == 0:
            found = np.concatenate([found, [[-1, 0, 0], [-1, 0, 1]]])
            sums = np.concatenate([sums, loss])
        columns = [pa.array(found[:, i].astype(np.int32)) for i in range(3)] + [pa.array(sums[:, i]) for i in range(2)]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "feature", "bin", "g", "h"])

    return task


def row_sample(seed: int, fraction: float) -> Callable[[np.ndarray], np.ndarray]:
    """Which rows, by their hashes, a round trains on: a share that depends on the seed only."""
    mix = np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))

    def kept(h: np.ndarray) -> np.ndarray:
        mixed = (h.astype(np.int64).view(np.uint64) ^ mix) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(11)).astype(float) / float(1 << 53) < fraction

    return kept


def best_splits(sums: np.ndarray, allowed: np.ndarray, ridge: float, least: float):
    """(feature, threshold, gain, left and right sums) for each (class and node); without a gain all rows go left."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    whole = sums.sum(axis=2, keepdims=True)
    right = whole - left

    def quality(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + ridge)

    gain = quality(left) + quality(right) - quality(whole)
    fits = (left[..., 1] >= least) & (right[..., 1] >= least) & allowed[None, :, None]
    gain = np.where(fits, gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    feature, threshold = np.unravel_index(best, gain.shape[1:])
    slot = np.arange(len(gain))
    won = flat[slot, best]
    split = won > 1e-12
    feature, threshold = np.where(split, feature, 0), np.where(split, threshold, sums.shape[2])
    to_left = np.where(split[:, None], left[slot, feature, np.minimum(threshold, left.shape[2] - 1)], whole[slot, 0, 0])
    return feature, threshold, np.where(split, won, 0.0), to_left, whole[slot, 0, 0] - to_left


def boosted_trees(
    df: DataFrame,
    features: list[str],
    label: str,
    valid: str | None = None,
    rounds: int = 100,
    rate: float = 0.1,
    depth: int = 4,
    n_bins: int = 32,
    ridge: float = 1.0,
    least: float = 1.0,
    feature_fraction: float = 0.8,
    row_fraction: float = 0.8,
    patience: int = 10,
    balanced: bool = False,
    refresh: int = 10,
    seed: int = 42,
) -> BoostedModel:
    """Softmax boosting: in each round a tree for each class, on second-order gains.

    Rows whose ``valid`` column is true aren't trained on; training stops when
    their log loss has not fallen for ``patience`` rounds, and the rounds after
    the best are dropped.  ``balanced`` gives all classes the same weight.

    Features are cut into at most ``n_bins`` bins (254 at most) at approximate
    quantiles; null and NaN are a bin of their own.  Binned rows are written
    once, those of a partition that have the same label and bins as one, and carry
    their margins, rewritten every ``refresh`` rounds; a level of a round is one
    pass over them without a shuffle of rows, that looks at each row's hash and
    at each group's bins.  What reaches the
    driver is classes x nodes x features x bins sums, whatever the number of
    rows.  Rows with a null label are left out; no rows at all are an error.
    """
    if not 2 <= n_bins <= 254:
        raise ValueError("n_bins must be from 2 to 254")
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull())
    held = F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)
    train = known.where(~held)
    counts = train.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if not counts or len(counts) > MOST_CLASSES:
        raise ValueError(f"training needs 1 to {MOST_CLASSES} labels")
    counts = sorted((r[0], r["count"]) for r in counts)
    labels, n_of = [v for v, _ in counts], np.array([n for _, n in counts], float)
    weights = n_of.sum() / (len(labels) * n_of) if balanced else np.ones(len(labels))
    numbers = train.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    cuts = numbers.approxQuantile(numbers.columns, [i / n_bins for i in range(1, n_bins)], 0.25 / n_bins)
    edges = [np.unique([v for v in e if v == v]) for e in cuts]
    model = BoostedModel(list(features), labels, edges, np.log(weights * n_of / (weights * n_of).sum()))
    width, classes = n_bins + 1, len(labels)

    index = F.coalesce(*[F.when(F.col(label) == F.lit(v), F.lit(i)) for i, v in enumerate(labels)])
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("y") + 1)
    values = feature_array(features)
    # a validation row of a label that training doesn't know has no loss
    given = known.select(index.alias("y"), held.alias("valid"), F.xxhash64(*features).alias("h"), values.alias("v")).where("y is not null")
    given = given.select("y", weight.alias("w"), "valid", "h", "v")
    base = model.base

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_: list[tuple] = []
        waiting = 0

        def groups() -> Iterator[pa.RecordBatch]:
            y, w, valid, h, bins = (np.concatenate(v) for v in zip(*held_, strict=True))
            order, starts = same_bins(y, valid, bins)
            ends = np.append(starts, len(order))
            for a in range(0, len(starts), WRITTEN):
                at, last = starts[a : a + WRITTEN], ends[min(a + WRITTEN, len(starts))]
                of = order[at]
                columns = [pa.array(v[of]) for v in (y, w, valid)]
                columns += [binary(h[order[at[0] : last]], at - at[0]), binary(bins[of]), binary(np.tile(base, (len(of), 1)))]
                yield pa.RecordBatch.from_arrays(columns, ["y", "w", "valid", "h", "bins", "margin"])

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            held_.append((*[b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "valid", "h")], binned(flat, edges)))
            waiting += b.num_rows
            if waiting >= GROUPED:
                yield from groups()
                held_, waiting = [], 0
        if held_:
            yield from groups()

    data = written(given.mapInArrow(to_bins, DATA))
    pending: list[Trees] = []

    def renewed(trees: list[Trees]) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = matrix(b.column("bins"), np.uint8, len(edges))
                new = binary(margins(bins, matrix(b.column("margin"), np.float64, classes), trees))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], new], b.schema.names)

        return written(data.mapInArrow(task, DATA))

    def sums_of(now: Trees, level: int, kept) -> tuple[np.ndarray, np.ndarray]:
        task = histogram_task(list(pending), now, level, width, kept)
        total = data.mapInArrow(task, HISTOGRAM).groupBy("slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = total.toPandas()
        out, loss = np.zeros((classes << level, len(edges), width, 2)), np.zeros((2, 2))
        for to, rows in ((loss, found[found["slot"] < 0]), (out, found[found["slot"] >= 0])):
            at = rows[["slot", "feature", "bin"]].to_numpy().T
            to[tuple(at) if to is out else at[2]] = rows[["g", "h"]].to_numpy() / UNIT
        return out, loss

    rng = np.random.default_rng(seed)
    gains: list[np.ndarray] = []
    best = 0
    for turn in range(rounds + 1):
        inner = (1 << depth) - 1
        now = Trees(np.zeros((classes, inner), np.int64), np.full((classes, inner), width, np.int64), np.zeros((classes, inner + 1)))
        kept = row_sample(seed * 1009 + turn, row_fraction)
        allowed = np.zeros(len(edges), bool)
        allowed[rng.choice(len(edges), max(1, round(feature_fraction * len(edges))), replace=False)] = True
        gain_of = np.zeros(len(edges))
        for level in range(depth):
            sums, loss = sums_of(now, level, kept)
            if level == 0:
                each = tuple(float(a / b) if b else float("nan") for a, b in loss)
                model.losses.append(each)
                judged = 1 if valid and loss[1, 1] else 0
                if each[judged] < model.losses[best][judged]:
                    best = turn
                if turn == rounds or (judged and turn - best >= patience):
                    break
            feature, threshold, won, left, right = best_splits(sums, allowed, ridge, least)
            nodes = 1 << level
            at = slice(nodes - 1, 2 * nodes - 1)
            now.feature[:, at], now.threshold[:, at] = feature.reshape(classes, nodes), threshold.reshape(classes, nodes)
            np.add.at(gain_of, feature, won)
            if level == depth - 1:
                for side, s in enumerate((left, right)):
                    now.leaf[:, side::2] = (-rate * s[:, 0] / (s[:, 1] + ridge)).reshape(classes, nodes)
        else:
            model.rounds.append(now)
            gains.append(gain_of)
            pending.append(now)
            if len(pending) == refresh:
                data = renewed(pending)
                pending = []
            continue
        break
    if valid and any(v == v for _, v in model.losses):
        model.rounds, gains = model.rounds[:best], gains[:best]
    model.gains = np.sum(gains, axis=0) if gains else np.zeros(len(edges))
    return model
