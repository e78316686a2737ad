"""Hard negatives by angular triangle filtering.

Every vector is stored with its length and its angles to a few reference
directions, in an order by label, nearest reference and angle to it, so that
windows of consecutive vectors have narrow ranges of angles.  Angles obey the
triangle inequality: where an anchor has angle a to a reference and a window's
vectors have angles from t0 to t1 to it, the angle between them is at least
max(a - t1, t0 - a, 0) and at most min(a + t1, 2 pi - a - t0).  All references
together give an interval of cosines, and with the lengths an interval of
scores, widened by more than rounding can do.  Only windows whose interval
overlaps what an anchor looks for get integer products.

Anchors are a table, as the vectors are: an anchor goes to the parts of the
layout whose interval overlaps, vectors go to each group of anchors, and a
cell of both is worked off as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inner_products import matrix, products, quantised, usable
from .shared_tables import written

#: Reference directions, and rows of the bounded sample that they are fitted to.
REFERENCES, SAMPLE = 16, 4096
#: Vectors of a window, vectors of a part of the layout and parts at most, anchors of a group.
WINDOW, PART, PARTS, ANCHORS = 64, 4096, 1024, 8192
#: Angles are wrong by less than this, and products of lengths and cosines by less than their share and one.
ANGLE_SLACK, SHARE_SLACK = 1e-6, 1e-9
LOWEST, HIGHEST = -(2**62), 2**62


def directions(vectors: np.ndarray, k: int = REFERENCES, rounds: int = 6) -> np.ndarray:
    """k unit vectors in the middle of groups of the given vectors (spherical k-means from far points)."""
    norm = np.sqrt((vectors**2).sum(1))
    unit = vectors[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return random_directions(vectors.shape[1], k)
    picked = [0]
    nearest = unit @ unit[0]
    while len(picked) < min(k, len(unit)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[picked[-1]])
    centre = unit[picked]
    for _ in range(rounds):
        of = (unit @ centre.T).argmax(1)
        total = np.stack([np.bincount(of, unit[:, d], len(centre)) for d in range(unit.shape[1])], 1)
        size = np.sqrt((total**2).sum(1))
        centre = np.where((size > 1e-9)[:, None], total / np.maximum(size, 1e-9)[:, None], centre)
    return centre


def random_directions(size: int, k: int = REFERENCES) -> np.ndarray:
    rng = np.random.default_rng(size)
    v = rng.normal(size=(k, size))
    return v / np.sqrt((v**2).sum(1))[:, None]


def angles_to(vectors: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of vectors to the references; a zero vector has a right angle to all, as its products are 0 anyway."""
    cosine = (vectors / np.maximum(norm, 1e-300)[:, None]) @ references.T
    return np.arccos(np.clip(cosine, -1, 1))


def score_bounds(
    angles: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray, shortest: np.ndarray, longest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of each anchor with the vectors of each window."""
    near, far = np.zeros((len(norm), len(shortest))), np.full((len(norm), len(shortest)), np.pi)
    for j in range(angles.shape[1]):
        a, t0, t1 = angles[:, j, None], least[:, j], most[:, j]
        np.maximum(near, np.maximum(a - t1, t0 - a), out=near)
        np.minimum(far, np.minimum(a + t1, 2 * np.pi - a - t0), out=far)
    high = np.cos(np.maximum(near - ANGLE_SLACK, 0))
    low = np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    high = np.where(high > 0, longest, shortest) * high * norm[:, None]
    low = np.where(low < 0, longest, shortest) * low * norm[:, None]
    return low - np.abs(low) * SHARE_SLACK - 1, high + np.abs(high) * SHARE_SLACK + 1


class Lists:
    """The k best (score, smaller id first) of each slot among scores from its floor to its ceiling."""

    def __init__(self, floor: np.ndarray, ceiling: np.ndarray, k: int):
        self.bound, self.ceiling, self.k = floor.copy(), ceiling, k
        self.score = np.full((len(floor), k), LOWEST, np.int64)
        self.found = np.full((len(floor), k), -1, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.bound[slots]) & (scores <= self.ceiling[slots])
        if not ok.any():
            return
        slots, scores, ids = slots[ok], scores[ok], ids[ok]
        touched = np.unique(slots)
        slots = np.r_[slots, np.repeat(touched, self.k)]
        ids, scores = np.r_[ids, self.found[touched].ravel()], np.r_[scores, self.score[touched].ravel()]
        order = np.lexsort((ids, -scores, slots))
        slots = slots[order]
        begin = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        pick = order[begin[:, None] + np.arange(self.k)]
        self.score[touched], self.found[touched] = scores[pick], ids[pick]
        self.bound[touched] = np.maximum(self.bound[touched], self.score[touched, -1])


class Cell:
    """A group of anchors that vectors stream past; each anchor has some slots with an interval of scores."""

    def __init__(self, ids, labels, vectors, norm, angles, floors, ceilings, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.norm, self.angles, self.same = ids, labels, vectors, norm, angles, same
        self.n_slots = floors.shape[1]
        self.lists = Lists(floors.ravel(), ceilings.ravel(), k)
        self.scored = self.seen = 0  # pairs

    def search(self, ids, labels, vectors, norm, angles) -> None:
        """Goes through vectors, which come in the order of the layout."""
        change = np.flatnonzero(labels[1:] != labels[:-1]) + 1
        begins = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(np.r_[0, change], np.r_[change, len(ids)], strict=True)])
        ends = np.r_[begins[1:], len(ids)]
        low, high = score_bounds(
            self.angles, self.norm, np.minimum.reduceat(angles, begins), np.maximum.reduceat(angles, begins),
            np.minimum.reduceat(norm, begins), np.maximum.reduceat(norm, begins),
        )
        lists, shape = self.lists, (len(self.ids), self.n_slots)
        bound, ceiling = lists.bound.reshape(shape), lists.ceiling.reshape(shape)
        for w, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            overlaps = ((high[:, w, None] >= bound) & (low[:, w, None] <= ceiling)).any(1)
            rows = np.flatnonzero(overlaps & ((self.labels == labels[a]) == self.same))
            self.seen += len(self.ids) * (b - a)
            self.scored += len(rows) * (b - a)
            if not len(rows):
                continue
            score = products(self.vectors[rows], vectors[a:b])
            wanted = (score >= bound[rows].min(1)[:, None]) & (score <= ceiling[rows].max(1)[:, None])
            r, c = np.nonzero(wanted & (self.ids[rows][:, None] != ids[a:b]))
            for slot in range(self.n_slots) if len(r) else ():
                lists.offer(rows[r] * self.n_slots + slot, score[r, c], ids[a:b][c])

    def found(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.lists.score > LOWEST)
        columns = [self.ids[slot // self.n_slots], slot % self.n_slots, self.lists.found[slot, place], self.lists.score[slot, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])


FOUND = "anchor_id long, slot long, vec_id long, score long"
CELL = ["n", "anchors", "part", "is_row"]


def worked_off(cells: DataFrame, k: int, same: bool) -> DataFrame:
    """The best of each anchor's slots in each cell; cells are sorted, anchors first."""
    names = [*CELL, "vec_id", "label", "v", "norm", "angles", "floors", "ceilings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, cell = None, [], None

        def columns(rows: pa.RecordBatch, size: int) -> list[np.ndarray]:
            ids, labels, norm = (rows.column(i).to_numpy() for i in (4, 5, 7))
            return [ids, labels, matrix(rows.column(6), size), norm, rows.column(8).flatten().to_numpy().reshape(len(ids), -1)]

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1).astype(np.int64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(keys)].tolist(), strict=True):
                if a == b:
                    continue
                *key, is_row = keys[a].tolist()
                rows = batch.slice(a, b - a)
                if key != at:
                    if cell is not None:
                        yield cell.found()
                    at, anchors, cell = key, [], None
                if not is_row:
                    lists = [rows.column(i).flatten().to_numpy().reshape(b - a, -1) for i in (9, 10)]
                    anchors.append([*columns(rows, key[0]), *lists])
                    continue
                if cell is None and anchors:
                    cell = Cell(*map(np.concatenate, zip(*anchors, strict=True)), k, same)
                if cell is not None:
                    cell.search(*columns(rows, key[0]))
        if cell is not None:
            yield cell.found()

    return cells.select(*names).mapInArrow(run, FOUND)


def layout(rows: DataFrame, n_rows: int) -> DataFrame:
    """The usable rows with norm, angles and part, written in order; parts are cut where a sample says, not by keys."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    by_size: dict[int, list] = {}
    for v in sample.to_pylist():
        by_size.setdefault(len(v), []).append(v)
    shared = spark.sparkContext.broadcast({n: directions(np.array(v, np.float64)) for n, v in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "label", "v", "n", "norm", "angles", "nearest", "nearest_angle"]
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                v = matrix(part.column("v"), n).astype(np.float64)
                norm = np.sqrt((v**2).sum(1))
                angles = angles_to(v, norm, shared.value[n] if n in shared.value else random_directions(n))
                nearest = angles.argmin(1)
                lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * angles.shape[1], angles.ravel())
                new = [pa.array(norm), lists, pa.array(nearest.astype(np.int32)), pa.array(angles[np.arange(len(v)), nearest])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    schema = "vec_id long, label long, v array<long>, n int, norm double, angles array<double>, nearest int, nearest_angle double"
    placed = rows.select("vec_id", "label", "v", F.size("v").alias("n")).mapInArrow(run, schema)
    order = ["n", "label", "nearest", "nearest_angle", "vec_id"]
    parts = max(1, min(PARTS, -(-n_rows // PART)))
    return written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def summary(rows: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """For each vector size the parts' labels, lengths and angles, from which to which; a row for each part and size."""
    least = [F.min(F.element_at("angles", i + 1)) for i in range(REFERENCES)]
    most = [F.max(F.element_at("angles", i + 1)) for i in range(REFERENCES)]
    stats = rows.withColumn("angles", padded(F.col("angles"))).groupBy("n", "part").agg(
        *[f(c).alias(f"{name}_{c}") for c in ("label", "norm") for f, name in ((F.min, "min"), (F.max, "max"))],
        F.array(*least).alias("least"), F.array(*most).alias("most"),
    )
    held: dict[int, list] = {}
    for r in stats.orderBy("n", "part").collect():
        held.setdefault(r["n"], []).append(r)
    fields = ("part", "min_label", "max_label", "min_norm", "max_norm", "least", "most")
    return {n: {c: np.array([r[c] for r in parts]) for c in fields} for n, parts in held.items()}


def padded(angles: Column) -> Column:
    """Few vectors give fewer references; the last one then counts more than once."""
    return F.concat(angles, F.array_repeat(F.element_at(angles, -1), F.lit(REFERENCES) - F.size(angles)))


def sent(anchors: DataFrame, parts: dict[int, dict[str, np.ndarray]], same: bool) -> DataFrame:
    """Each anchor once for each part that may hold what it looks for."""
    shared = anchors.sparkSession.sparkContext.broadcast(parts)
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, labels, norms = (batch.column(c).to_numpy() for c in ("n", "label", "norm"))
            for n in np.unique(sizes).tolist():
                mine, p = np.flatnonzero(sizes == n), shared.value[n]
                rows = batch.take(pa.array(mine))
                label, one = labels[mine][:, None], p["min_label"] == p["max_label"]
                if same:
                    go = (label >= p["min_label"]) & (label <= p["max_label"])
                else:
                    go = ~(one & (label == p["min_label"]))
                angles = rows.column("angles").flatten().to_numpy().reshape(len(mine), -1)
                low, high = score_bounds(angles, norms[mine], p["least"], p["most"], p["min_norm"], p["max_norm"])
                floors, ceilings = (rows.column(c).flatten().to_numpy().reshape(len(mine), -1) for c in ("floors", "ceilings"))
                for slot in range(floors.shape[1]):
                    overlap = (high >= floors[:, slot, None]) & (low <= ceilings[:, slot, None])
                    some = overlap if slot == 0 else some | overlap
                row, part = np.nonzero(go & some)
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(row)).columns, pa.array(p["part"][part], pa.int32())], names=[*names, "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields) + ", part int"
    return anchors.mapInArrow(run, schema)


def best_in_cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, parts: dict, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): each slot's k best over all rows, from the best of each cell."""
    groups = max(1, -(-n_anchors // ANCHORS))
    empty = F.array().cast("array<long>")
    left = sent(anchors, parts, same).withColumns({"anchors": F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"), "is_row": F.lit(0)})
    right = rows.withColumns({"floors": empty, "ceilings": empty, "is_row": F.lit(1), "anchors": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    columns = [*CELL, "vec_id", "label", "v", "norm", "angles", "floors", "ceilings", "nearest", "nearest_angle"]
    both = left.select(*columns).unionByName(right.select(*columns))
    cells = both.repartition("n", "anchors", "part").sortWithinPartitions(*CELL, "label", "nearest", "nearest_angle", "vec_id")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return worked_off(cells, k, same).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    percent: int = 80,
    n_positives: int = 5,
    n_negatives: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is an integer inner
    product.  An anchor's positives are its ``n_positives`` best other rows of
    its label; the negatives of a positive with score s are the
    ``n_negatives`` best rows of another label with scores from percent * s /
    100 to s.  Ties go to the smaller id; there is none where s is negative.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part; vectors of different size don't meet.
    Where rows repeat an anchor's id the smallest (label, vector) is the
    anchor, and none of them is its positive or negative; other repeated rows
    count each on their own.  A zero vector has score 0 with all.  An empty
    table, or one without anchors, gives no rows.  Clashing names of other
    columns don't matter, as only id, vector and label are read.  Products
    beyond 64 bits overflow.
    """
    spark = vectors.sparkSession
    vector, vec_id = F.col(f"`{vec_col}`"), F.col(f"`{id_col}`")
    usable_rows = vectors.where(usable(vector) & vec_id.isNotNull() & label.isNotNull())
    rows = usable_rows.select(
        vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised(vector, scale).alias("v"), is_anchor.alias("asked")
    )
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("asked")).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = layout(rows, n_rows)
    parts = summary(placed)
    asked = rows.where("asked").select("vec_id").distinct()
    first = F.min(F.struct("label", "v", "n", "norm", "angles", "nearest", "nearest_angle")).alias("x")
    anchors = placed.join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(first).select("vec_id", "x.*").withColumn("angles", padded(F.col("angles")))
    placed = placed.withColumn("angles", padded(F.col("angles")))

    def slots(floors: Column, ceilings: Column) -> dict[str, Column]:
        return {"floors": floors.cast("array<long>"), "ceilings": ceilings.cast("array<long>")}

    anyone = anchors.withColumns(slots(F.array(F.lit(LOWEST)), F.array(F.lit(HIGHEST))))
    best = best_in_cells(anyone, placed, n_anchors, parts, n_positives, same=True)
    positives = written(best.select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # ceil(percent * s / 100) in whole numbers; missing positives have an empty interval
    listed = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    listed = listed.withColumn("s", F.transform("p", lambda x: x["positive_score"])).withColumn("gap", F.lit(n_positives) - F.size("p"))
    lows = F.transform("s", lambda s: F.call_function("div", percent * s + F.pmod(-percent * s, F.lit(100)), F.lit(100)))
    ask = listed.select(
        "vec_id",
        F.concat(lows.cast("array<long>"), F.array_repeat(F.lit(HIGHEST), F.col("gap"))).alias("floors"),
        F.concat("s", F.array_repeat(F.lit(LOWEST), F.col("gap"))).alias("ceilings"),
    )
    found = best_in_cells(anchors.join(ask, "vec_id"), placed, n_anchors, parts, n_negatives, same=False)
    of = positives.withColumn("slot", F.col("rank").cast("long") - 1).drop("rank")
    return found.join(of, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
