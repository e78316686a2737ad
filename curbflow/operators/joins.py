"""Joins: lookups, checks, as-of and rule joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined with right, whose keys must be unique; an error otherwise."""
    if not right.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"the right side repeats values of {key}")
    return left.join(right, key, how)


def coverage(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of both sides, how many of ``want`` are found and missing."""
    a = have.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("have", F.lit(True))
    b = want.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("want", F.lit(True))
    both = a.join(b, "k", "full")
    return both.agg(
        F.count("have").alias("n_have"),
        F.count("want").alias("n_want"),
        F.count_if(F.col("have") & F.col("want")).alias("n_found"),
        F.count_if(F.col("have").isNull()).alias("n_missing"),
    )


def latest_rows(right: DataFrame, ts: str, order: list[Column]) -> DataFrame:
    """One row for each time: the last in the given order."""
    nth = F.row_number().over(Window.partitionBy(ts).orderBy(*order))
    return right.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def asof_nearest(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance_s: int) -> DataFrame:
    """left with the columns of the right row nearest in time, at most ``tolerance_s`` away (inclusive).

    Ties take the earlier row; times of right must be unique.  Both sides'
    distinct times lie in one order within buckets as wide as the tolerance;
    windows bring the last row before and the first after, and what may lie
    over a bucket's edge are the last row of the bucket before and the first of
    the one after.  So each row is looked at a fixed number of times, however
    many fall into one tolerance.
    """
    width = max(1, tolerance_s * 1_000_000)
    columns = [c for c in right.columns if c != right_ts]
    row = F.struct(micros(F.col(right_ts)).alias("m"), F.col(right_ts).alias("r"), *columns)
    rights = right.where(F.col(right_ts).isNotNull()).select(F.col(right_ts).alias("t"), row.alias("row"))
    lefts = left.select(F.col(left_ts).alias("t")).where("t is not null").distinct()
    both = lefts.withColumn("row", F.lit(None).cast(rights.schema["row"].dataType)).unionByName(rights)
    both = both.withColumn("b", F.floor(micros(F.col("t")) / width))
    edges = both.where("row is not null").groupBy("b").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    # both look back, in either order: a frame that reaches to the end is worked out anew for each row
    prev, nxt = (
        F.last("row", ignorenulls=True).over(Window.partitionBy("b").orderBy(t, F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, 0))
        for t in (F.asc("t"), F.desc("t"))
    )
    asks = both.withColumns({"prev": prev, "next": nxt}).where("row is null").drop("row")
    asks = asks.join(edges.select((F.col("b") + 1).alias("b"), F.col("last").alias("before")), "b", "left")
    asks = asks.join(edges.select((F.col("b") - 1).alias("b"), F.col("first").alias("after")), "b", "left")
    m, a, b = micros(F.col("t")), F.coalesce("prev", "before"), F.coalesce("next", "after")
    a, b = F.when(m - a["m"] <= tolerance_s * 1_000_000, a), F.when(b["m"] - m <= tolerance_s * 1_000_000, b)
    best = F.when(b.isNull() | (m - a["m"] <= b["m"] - m), a).otherwise(b)
    # one row a distinct time grows with the input: by shuffles, not through the driver
    found = asks.select(F.col("t").alias("__t"), best.alias("__best")).hint("merge")
    joined = left.join(found, F.col(left_ts) == F.col("__t"), "left")
    return joined.select(
        *[left[c] for c in left.columns], F.col("__best.r").alias(right_ts), *[F.col(f"__best.{c}").alias(c) for c in columns]
    )


def asof_nearest_unbounded(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str) -> DataFrame:
    """left with the columns of the right row nearest in time, however far; ties take the earlier row.

    Within a day, prefix and suffix windows find the neighbours.  What reaches
    over a day's edge comes from a table with one row for each day, whose
    windows carry the last row before and the first after each day.
    """
    columns = [c for c in right.columns if c != right_ts]
    row = F.struct(F.col(right_ts).alias("r"), *columns)
    rights = right.where(F.col(right_ts).isNotNull()).select(F.col(right_ts).alias("t"), row.alias("row"))
    lefts = left.select(F.col(left_ts).alias("t")).where("t is not null").distinct()
    both = lefts.select("t", F.lit(None).cast(rights.schema["row"].dataType).alias("row")).unionByName(rights)
    both = both.withColumn("day", F.to_date("t"))
    by_day = both.groupBy("day").agg(F.max_by("row", F.when(F.col("row").isNotNull(), F.col("t"))).alias("last"),
                                     F.min_by("row", F.when(F.col("row").isNotNull(), F.col("t"))).alias("first"))
    years = Window.partitionBy(F.lit(0)).orderBy("day")
    carried = by_day.select(
        "day",
        F.last("last", ignorenulls=True).over(years.rowsBetween(Window.unboundedPreceding, -1)).alias("before_day"),
        F.first("first", ignorenulls=True).over(years.rowsBetween(1, Window.unboundedFollowing)).alias("after_day"),
    )
    # both look back, in either order: a frame that reaches to the end is worked out anew for each row
    prev, nxt = (
        F.last("row", ignorenulls=True).over(Window.partitionBy("day").orderBy(t, F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, 0))
        for t in (F.asc("t"), F.desc("t"))
    )
    known = both.withColumns({"prev": prev, "next": nxt}).where("row is null").join(F.broadcast(carried), "day", "left")
    a, b = F.coalesce("prev", "before_day"), F.coalesce("next", "after_day")
    closer = (micros(F.col("t")) - micros(a["r"])) <= (micros(b["r"]) - micros(F.col("t")))
    best = known.select(F.col("t").alias("__t"), F.when(b.isNull() | (a.isNotNull() & closer), a).otherwise(b).alias("__best"))
    joined = left.join(best.hint("merge"), F.col(left_ts) == F.col("__t"), "left")
    return joined.select(
        *[left[c] for c in left.columns], F.col("__best.r").alias(right_ts), *[F.col(f"__best.{c}").alias(c) for c in columns]
    )
