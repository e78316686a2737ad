"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are laid out by length, longest first, in parts, and queries in groups.
A query goes to the parts whose longest vector may give it a score that counts; a
group meets a part in one cell, a group of a shuffle, which cuts the part's
rows into buckets of similar length.  For a query q with current k-th score s,
a bucket whose longest vector has length l can only help with vectors whose
cosine with q reaches t = s / (|q| l), the bucket's local threshold:

* t > 1: the bucket is skipped;
* t large: coordinate pruning - only vectors whose share on q's largest
  coordinate lies in the interval that cosine t allows;
* otherwise: length pruning - only vectors of length s / |q| or more.

What stays is verified by its product.  A first bound for s comes from a fixed
number of the longest vectors.  One plan serves any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.shared_tables import written

#: Vectors of a bucket, vectors that give first bounds, and queries of a group.
BUCKET, PILOT, QUERIES = 2048, 2048, 4096
#: Vectors of a part, and the most parts, whose greatest lengths every task knows.
PART, PARTS = 1 << 15, 1 << 14
#: Local threshold from which coordinates prune rather than lengths.
COORDINATE_FROM = 0.6
#: Queries that are multiplied with a bucket at once.
GROUP = 512
LOWEST = -(2**62)


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best (score, smaller id first) for each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.bound = bound.copy()  # a score below it can't be among the k best
        self.score = np.full((len(ids), k), LOWEST, np.int64)
        self.found = np.full((len(ids), k), -1, np.int64)

    def offer(self, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates `ids[cols]` with their scores for the queries `rows`."""
        ok = (scores >= self.bound[rows]) & (ids[cols] != self.ids[rows])
        rows, cols, scores = rows[ok], cols[ok], scores[ok]
        if not len(rows):
            return
        touched = np.unique(rows)
        all_rows = np.r_[rows, np.repeat(touched, self.k)]
        all_ids = np.r_[ids[cols], self.found[touched].ravel()]
        all_scores = np.r_[scores, self.score[touched].ravel()]
        order = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows = all_rows[order]
        begin = np.flatnonzero(np.r_[True, all_rows[1:] != all_rows[:-1]])
        pick = order[(begin[:, None] + np.arange(self.k))]
        self.score[touched], self.found[touched] = all_scores[pick], all_ids[pick]
        self.bound[touched] = np.maximum(self.bound[touched], self.score[touched, -1])

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Goes through one bucket; its vectors come longest first."""
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        unit = vectors / np.maximum(norm, 1e-300)[:, None]
        longest = norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.norm * longest > 0, self.bound / (self.norm * longest), np.where(self.bound > 0, 2.0, -1.0))
        local = np.where(self.bound == LOWEST, -1.0, local)
        everything = np.flatnonzero(local < COORDINATE_FROM)
        for low in range(0, len(everything), GROUP):
            q = everything[low : low + GROUP]
            # length pruning: the shortest useful length over the group of queries
            need = np.where(self.bound[q] > 0, self.bound[q] / np.maximum(self.norm[q], 1e-300), 0).min() * (1 - 1e-9)
            m = int(np.searchsorted(-norm, -need, side="right"))
            s = products(self.vectors[q], vectors[:m])
            s[self.ids[q][:, None] == ids[:m]] = LOWEST  # rows of the query's id, however many, are no candidates
            cut = self.bound[q]
            if m > 4 * self.k:
                cut = np.maximum(cut, np.partition(s, m - self.k, axis=1)[:, m - self.k])
            rows, cols = np.nonzero(s >= cut[:, None])
            self.offer(q[rows], cols, s[rows, cols], ids)
        by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + 1e-9)).tolist():
            f = int(np.abs(self.vectors[q]).argmax())
            if f not in by_coordinate:
                order = np.argsort(unit[:, f], kind="stable")
                by_coordinate[f] = order, unit[order, f]
            order, values = by_coordinate[f]
            t, x = min(local[q], 1.0), self.vectors[q, f] / self.norm[q]
            half = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
            a, b = np.searchsorted(values, (x * t - half, x * t + half + (1 - t)))
            if x < 0:
                a = np.searchsorted(values, x * t - half - (1 - t))
            near = order[a:b]
            if len(near):
                s = products(self.vectors[q : q + 1], vectors[near])[0]
                self.offer(np.full(len(near), q), near, s, ids)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


FOUND = "query_id long, vec_id long, score long"
CELL = ["n", "queries", "part", "is_row"]


def worked_off(cells: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each cell; a cell's queries come first, then its vectors, longest first."""

    def found(best: Best) -> pa.RecordBatch:
        keep = best.score > LOWEST
        row = np.repeat(np.arange(len(best.ids)), keep.sum(1))
        columns = [pa.array(x) for x in (best.ids[row], best.found[keep], best.score[keep])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1).astype(np.int64)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(keys)].tolist(), strict=True):
                if a == b:
                    continue
                *key, is_row = keys[a].tolist()
                rows = batch.slice(a, b - a)
                ids, v = rows.column(4).to_numpy(), matrix(rows.column(5), key[0])
                if key != at:
                    if best is not None:
                        yield found(best)
                    at, asked, best = key, [], None
                if not is_row:
                    asked.append((ids, v, rows.column(6).to_numpy()))
                    continue
                if best is None and asked:
                    best = Best(*map(np.concatenate, zip(*asked, strict=True)), k)
                for low in range(0, len(ids) if best is not None else 0, BUCKET):
                    best.search(ids[low : low + BUCKET], v[low : low + BUCKET])
        if best is not None:
            yield found(best)

    return cells.select(*CELL, "vec_id", "v", "bound").mapInArrow(run, FOUND)


def bounded(queries: DataFrame, pilot: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """queries with ``bound``: the k-th best score among the pilot's vectors, where it has k others of the size."""
    shared = queries.sparkSession.sparkContext.broadcast(pilot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            bound = np.full(len(sizes), LOWEST, np.int64)
            for n in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == n)
                if n in shared.value:
                    rows = batch.take(pa.array(mine))
                    best = Best(rows.column("vec_id").to_numpy(), matrix(rows.column("v"), n), bound[mine], k)
                    best.search(*shared.value[n])
                    bound[mine] = best.bound
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=[*batch.schema.names, "bound"])

    return queries.mapInArrow(run, "vec_id long, v array<long>, n int, norm double, bound long")


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest products, ties to the smaller id.

    A component x counts as floor(scale * x).  Queries are the rows for which
    ``is_query`` holds; rows with a query's own id are not its candidates.
    Vectors that are null or empty or hold a null or non-finite component take
    no part, nor do null ids; vectors of different size don't meet.  If rows
    repeat a query's id the smallest vector is the query; repeated candidates
    count each on their own.  An empty table, or one without queries, gives no
    rows.  Products beyond 64 bits overflow.
    """
    spark = vectors.sparkSession
    vector = F.col(f"`{vec_col}`")
    clean = vectors.where(usable(vector) & F.col(f"`{id_col}`").isNotNull())
    rows = clean.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(vector, scale).alias("v"), is_query.alias("asked")
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.select("*", F.size("v").alias("n"), length.alias("norm"))
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if("asked")).first()
    if not n_queries:
        return spark.createDataFrame([], FOUND).selectExpr("query_id", "1 AS rank", "vec_id", "score")
    order = ["n", F.desc("norm"), "vec_id"]
    placed = rows.repartitionByRange(max(1, min(PARTS, -(-n_rows // PART))), *order)
    placed = written(placed.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    pilot: dict[int, list] = {}
    for r in placed.orderBy(F.desc("norm"), "vec_id").limit(PILOT).select("vec_id", "v").collect():
        pilot.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
    first = {n: (np.array([i for i, _ in some]), np.array([v for _, v in some], np.int64)) for n, some in pilot.items()}
    queries = placed.where("asked").groupBy("vec_id", "n").agg(F.min("v").alias("v"))
    # a repeated id of several sizes asks with each of them, as vectors of different size don't meet
    queries = bounded(queries.select("vec_id", "v", "n", length.alias("norm")), first, k)
    longest = placed.groupBy("n", "part").agg(F.max("norm").alias("longest"))
    groups = -(-n_queries // QUERIES)
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("queries")
    sent = queries.join(longest, "n").where(F.col("bound") <= F.col("norm") * F.col("longest") * (1 + 1e-9)).select("n", group, "part", "vec_id", "v", "bound", "norm")
    sent = written(sent)
    cells = sent.select("n", "queries", "part").distinct()
    left = sent.withColumn("is_row", F.lit(0))
    right = placed.join(cells, ["n", "part"]).withColumns({"bound": F.lit(LOWEST), "is_row": F.lit(1)})
    columns = [*CELL, "vec_id", "v", "bound", "norm"]
    both = left.select(*columns).unionByName(right.select(*columns)).repartition("n", "queries", "part")
    found = worked_off(both.sortWithinPartitions(*CELL, F.desc("norm"), "vec_id"), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
