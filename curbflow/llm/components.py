"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up
from .shared_tables import forget, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node reachable.

    Rounds of smallest-neighbour labels with a pointer jump (a node also takes
    its label's label), until nothing changes.  A node with many edges is summed
    before it is shuffled, and the labels of such nodes and of large components
    are looked up in a broadcast of bounded size.  Rounds grow with the
    logarithm of a component's diameter in practice; if ``max_rounds`` don't
    suffice an error is raised, never a partial result.  Repeated edges and
    edges of a node with itself change nothing; no edges give no rows.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degrees = written(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        of_b = labels.withColumnRenamed("node", "b")
        near = looked_up(both, of_b, "b", "a", degrees).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        joined = written(labels.join(near.withColumnRenamed("a", "node"), "node"))
        new = written(
            looked_up(joined, jump, "label", "node").select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("old"))
        )
        forget(labels, joined)
        done = new.where(F.col("label") != F.col("old")).isEmpty()
        labels = new.select("node", "label")
        labels._shared_table = new._shared_table
        if done:
            forget(both, degrees)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
