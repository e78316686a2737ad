"""Holiday and event calendars as small tables, and the joins with them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: National and Catalan public holidays with a fixed date (month, day).
NATIONAL = [(1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)]
CATALAN = [(6, 24), (9, 11), (12, 26)]
#: Days after Easter Sunday: Good Friday; with Easter Monday in Catalonia.
NATIONAL_MOVING = [-2]
CATALAN_MOVING = [1]

#: School holidays, closed ranges.
SCHOOL_HOLIDAYS = [
    ("2021-12-23", "2022-01-07"),
    ("2022-04-11", "2022-04-18"),
    ("2022-06-06", "2022-06-06"),
    ("2022-06-23", "2022-09-10"),
    ("2022-09-26", "2022-09-26"),
    ("2022-12-22", "2023-01-08"),
    ("2023-04-03", "2023-04-10"),
    ("2023-06-05", "2023-06-05"),
    ("2023-06-21", "2023-09-10"),
    ("2023-09-25", "2023-09-25"),
    ("2023-12-21", "2023-12-31"),
]


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar, from the paschal full moon."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= epact // 28 * (1 - 29 // (epact + 1) * ((21 - golden) // 11))
    moon_day = (year + year // 4 + epact + 2 - century + century // 4) % 7
    return date(year, 3, 28) + timedelta(epact - moon_day)


def public_holidays(spark: SparkSession, years: range, region: str | None = None) -> DataFrame:
    """(holiday) dates of the years; region "CT" adds the Catalan ones."""
    fixed = NATIONAL + (CATALAN if region == "CT" else [])
    moving = NATIONAL_MOVING + (CATALAN_MOVING if region == "CT" else [])
    days = {date(y, m, d) for y in years for m, d in fixed} | {easter(y) + timedelta(n) for y in years for n in moving}
    return spark.createDataFrame([(d,) for d in sorted(days)], "holiday date")


def school_holidays(spark: SparkSession) -> DataFrame:
    rows = [(date.fromisoformat(a), date.fromisoformat(b)) for a, b in SCHOOL_HOLIDAYS]
    return spark.createDataFrame(rows, "start date, end date")


#: Rows of a table that is still broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows have been counted and are few; else joins shuffle it."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def with_date_flag(df: DataFrame, day: Column, dates: DataFrame, flag: str) -> DataFrame:
    """df with a 0/1 flag: whether ``day`` is among the dates (one column, broadcast if small)."""
    known = small(dates.select(F.col(dates.columns[0]).cast("date").alias("__day")).distinct())
    joined = df.withColumn("__of", day.cast("date")).join(known, F.col("__of") == F.col("__day"), "left")
    return joined.withColumn(flag, F.col("__day").isNotNull().cast("int")).drop("__of", "__day")


def dates_of_ranges(ranges: DataFrame) -> DataFrame:
    """The distinct dates of closed ranges (start, end)."""
    return ranges.select(F.explode(F.sequence("start", "end")).alias("day")).distinct()


def whole_day_end(end: Column) -> Column:
    """An end at midnight stands for the end of that day."""
    ts = end.cast("timestamp")
    return F.when(F.date_trunc("day", ts) == ts, ts + F.expr("INTERVAL 86399 SECONDS")).otherwise(ts).cast("timestamp_ntz")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """Overlapping closed intervals (start, end) as one; the calendar is small, so one window orders it."""
    from pyspark.sql import Window

    by_year = Window.partitionBy(F.lit(0)).orderBy("start", "end")
    before = F.max("end").over(by_year.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(by_year)
    return intervals.withColumn("island", island).groupBy("island").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("island")


def with_interval_flag(df: DataFrame, ts: str, intervals: DataFrame, flag: str) -> DataFrame:
    """df with a 0/1 flag: whether ``ts`` lies in any closed interval (start, end); 0 where it is null.

    Intervals are merged and dealt to the days that they touch, one row a day
    with its disjoint intervals in order.  A row looks its day up there, so df
    isn't shuffled as long as the calendar is small.
    """
    daily = merged_intervals(intervals).select(
        F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))).alias("__day"), "start", "end"
    )
    by_day = daily.groupBy("__day").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__open"))
    joined = df.withColumn("__of", F.col(ts).cast("date")).join(small(by_day), F.col("__of") == F.col("__day"), "left")
    inside = F.exists("__open", lambda i: (F.col(ts) >= i["start"]) & (F.col(ts) <= i["end"]))
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False)).cast("int")).drop("__of", "__day", "__open")
