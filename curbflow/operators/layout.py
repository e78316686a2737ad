"""Places in a total order, from one range layout that is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.sources.scratch import written


def range_layout(df: DataFrame, order: list[str], part: str = "__p", place: str = "__i") -> DataFrame:
    """df sorted into range partitions and written, each row with its partition and its place there.

    Two plans over the same repartitioning need not agree: each samples its own
    bounds, and adaptive execution may merge partitions in one of them.  So
    everything about partitions must come from the table that this returns.
    """
    m = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", m)
    placed = ordered.withColumns({part: F.shiftright("__m", 33), place: F.col("__m").bitwiseAND((1 << 33) - 1)})
    return written(placed.drop("__m"))


def with_row_index(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """df with the place of each row in a total order, from 0.

    A row's place is its place in its partition of the range layout plus the
    sizes of the partitions before, of which there is one row each.  Rows that
    tie in ``order`` have neighbouring places; null keys come first; an empty
    table stays empty.
    """
    laid = range_layout(df, order)
    sizes = laid.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    joined = laid.join(F.broadcast(starts), "__p", "left")
    start = F.coalesce("__start", F.raise_error(F.lit("a partition of the layout has no offset")).cast("long"))
    return joined.withColumn(name, start + F.col("__i")).select(*df.columns, name)
