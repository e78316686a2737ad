"""Profiles and quality reports as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import range_layout


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share); nulls are a value of their own."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def shares_within(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Counts of a column's values in each group, and their shares of the group."""
    counts = df.groupBy(*group, column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, nonzero_pct): one pass over all columns, then one row for each."""
    stats = df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
                (100.0 * F.count_if(F.col(c) != 0) / F.count("*")).alias("nonzero_pct"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.unpivot([], columns, "feature", "s").select("feature", "s.*")


FIVE = [0.0, 0.25, 0.5, 0.75, 1.0]


def exact_quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, quantiles): the exact quantiles of a column, interpolated between neighbours; nulls don't count.

    Values are counted first.  The counts are range-partitioned and written, a partition
    learns how many values lie before it (one row for each partition and group),
    and the neighbours of each quantile are the rows whose range of places holds
    its place.  No buffer holds a group's values, and no task all of them.
    Nulls in `by` are a group.  Without values there is one row with nulls (by
    nothing) or no row.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    order = [*by, "__v"]
    placed = range_layout(counts, order)
    sizes = placed.groupBy("__p", *by).agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__size").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__by_{c}") for c in by], F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__size").over(group).alias("__all"))
    inside = Window.partitionBy("__p", *by).orderBy("__v")
    ranked = placed.withColumn("__upto", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("__p") == F.col("__q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    ranked = ranked.join(starts if by else F.broadcast(starts), same)
    end = F.col("__start") + F.col("__upto")
    picks = []
    for i, q in enumerate(shares):
        at = F.lit(q) * (F.col("__all") - 1)
        for name, place in (("a", F.floor(at)), ("b", F.ceil(at))):
            held = (place < end) & (place >= end - F.col("__n"))
            picks.append(F.max(F.when(held, F.col("__v").cast("double"))).alias(f"__{name}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"__f{i}"))
    row = ranked.groupBy(*by).agg(*picks)
    of = [F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}") for i in range(len(shares))]
    return row.select(*by, F.array(*of).alias("quantiles"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, nulls, pct) of columns with nulls."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("__rows"))
    long = row.unpivot(["__rows"], columns, "feature", "nulls")
    return long.where("nulls > 0").select("feature", "nulls", (100.0 * F.col("nulls") / F.col("__rows")).alias("pct"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: whether the key is unique, its repeated values and the rows with them."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        (F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("is_unique"),
        F.count_if(F.col("n") > 1).alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows"),
    )


def varying_in_duplicates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(feature, varies): whether a column has several values within a repeated key."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("__n"), *[(F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(c) for c in columns]
    )
    row = per_key.where("__n > 1").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in columns])
    return row.unpivot([], columns, "feature", "varies")


def histogram(df: DataFrame, column: str, low: float | Column, high: float | Column, bins: int) -> DataFrame:
    """(bin, n) of equal-width bins from 1; the upper bound belongs to the last bin, values outside are left out."""
    inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
    place = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)) + 1, F.lit(bins))
    return inside.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def above_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the exact quantile and how many rows lie above it."""
    cut = F.broadcast(exact_quantiles(df, column, [q]).select(F.col("quantiles")[0].alias("threshold")))
    return df.crossJoin(cut).groupBy("threshold").agg(F.count_if(F.col(column) > F.col("threshold")).alias("n_above"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that meet each condition, counted in one pass."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return row.unpivot([], list(rules), "rule", "n")


def ordered_lines(df: DataFrame, key: str, order: str, x: str, y: str, label: str) -> DataFrame:
    """(key, label, line): each key's points in order as a line; keys with fewer than two points are left out."""
    rows = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, x, y, label))).alias("rows"), F.count("*").alias("n")
    )
    line = F.transform("rows", lambda r: F.struct(r[x].alias("x"), r[y].alias("y")))
    return rows.where("n >= 2").select(key, F.element_at("rows", 1)[label].alias(label), line.alias("line"))
