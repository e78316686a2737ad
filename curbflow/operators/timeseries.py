"""Panel operators: one shuffle by segment serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Microsecond-exact seconds of a local timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def floor_to(ts: Column, step_s: int) -> Column:
    whole = F.floor(F.unix_seconds(ts.cast("timestamp")) / step_s) * step_s
    return F.timestamp_seconds(whole).cast("timestamp_ntz")


#: Labels of one array of a resampled grid.
STRETCH = 4096


def resample_ffill(
    df: DataFrame, key: str, ts: str, value: str, step_s: int = 300, reset_monthly: bool = False
) -> DataFrame:
    """(key, ts, value) on the grid from each key's first to its last label.

    A label has the last reading at or before it, null before the first.  Only
    readings are sorted: what counts from a label on holds to the next that has
    a reading, and these stretches are laid out in arrays of ``STRETCH`` labels.
    With ``reset_monthly`` values don't cross into the next month.  Readings with
    a null key or time are left out; of several at one time the largest counts.
    """
    readings = df.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(value).alias("v")).where(
        "k is not null and t is not null"
    )
    step, whole = F.expr(f"INTERVAL {step_s} SECONDS"), F.expr(f"INTERVAL {step_s * STRETCH} SECONDS")
    low = floor_to(F.col("t"), step_s)
    at = F.when(low < F.col("t"), low + step).otherwise(low)
    keys = ["k", "m"] if reset_monthly else ["k"]
    last = F.max(F.when(F.col("v").isNotNull(), F.struct("t", "v")))
    met = readings.withColumns({"m": F.trunc("t", "month"), "low": low, "at": at}).groupBy(*keys, "at")
    met = met.agg(last.alias("last"), F.min("low").alias("low"), F.max("low").alias("high"))
    part = Window.partitionBy(*keys)
    order = part.orderBy("at")
    held = met.select(
        "k",
        "at",
        "low",
        F.row_number().over(order).alias("nth"),
        F.last("last.v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("v"),
        (F.lead("at").over(order) - step).alias("next"),
        F.max("high").over(part).alias("high"),
    )

    def stretch(when: Column, first: Column, end: Column, v: Column) -> Column:
        one = F.struct(first.alias("first"), end.alias("end"), v.cast(readings.schema["v"].dataType).alias("v"))
        return F.array_compact(F.array(F.when(when, one)))

    before = stretch((F.col("nth") == 1) & (F.col("low") < F.col("at")), F.col("low"), F.col("low"), F.lit(None))
    since = stretch(F.col("at") <= F.col("high"), F.col("at"), F.least("next", "high"), F.col("v"))
    grid = held.select("k", F.inline(F.concat(before, since)))
    grid = grid.select("k", "v", "end", F.explode(F.sequence("first", "end", whole)).alias("first"))
    labels = F.sequence("first", F.least(F.col("end"), F.col("first") + whole - step), step)
    grid = grid.select("k", F.explode(labels).alias("t"), "v")
    return grid.select(F.col("k").alias(key), F.col("t").alias(ts), F.col("v").alias(value))


def row_lags(df: DataFrame, key: str, ts: str, value: str, steps: dict[str, int]) -> DataFrame:
    """Values so many rows earlier within the key; all lags share one window."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumns({name: F.lag(value, n).over(w) for name, n in steps.items()})


def exact_lag(df: DataFrame, key: str, ts: str, value: str, lag_s: int, name: str) -> DataFrame:
    """The value at exactly ``lag_s`` seconds earlier, null where there is none; (key, ts) is unique."""
    then = (F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {lag_s} SECONDS")).cast("timestamp_ntz")
    past = df.select(F.col(key).alias("__k"), then.alias("__t"), F.col(value).alias(name))
    joined = df.join(past, (F.col(key) == F.col("__k")) & (F.col(ts) == F.col("__t")), "left")
    return joined.drop("__k", "__t")


def fill_both_ways(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Forward, then backward fill within the key; keys without any value go."""
    # both look back, in either order: a frame that reaches to the end is worked out anew for each row
    back, ahead = (
        F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)) for t in (F.asc(ts), F.desc(ts))
    )
    return df.withColumn(value, F.coalesce(back, ahead)).where(F.col(value).isNotNull())


def with_gap(df: DataFrame, key: str, ts: str, name: str = "gap_s") -> DataFrame:
    """Seconds since the key's previous row."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn(name, seconds(F.col(ts)) - seconds(F.lag(ts).over(w)))


def gap_report(df: DataFrame, key: str, ts: str, over_s: float) -> DataFrame:
    """Number of gaps longer than ``over_s`` and the largest gap of each key."""
    gaps = with_gap(df, key, ts)
    return gaps.groupBy(key).agg(F.count_if(F.col("gap_s") > over_s).alias("n_gaps"), F.max("gap_s").alias("largest_gap_s"))


def missing_dates(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Dates of the closed range without any row."""
    days = df.sparkSession.sql(f"SELECT explode(sequence(date '{start}', date '{end}')) AS day")
    return days.join(df.select(F.to_date(ts).alias("day")).distinct(), "day", "left_anti")


def with_neighbours(df: DataFrame, key: str, ts: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*ts)
    return df.withColumns({"prev_state": F.lag(value).over(w), "next_state": F.lead(value).over(w)})


def runs(df: DataFrame, key: str, ts: list[str], value: str) -> DataFrame:
    """(key, state, run, length): maximal runs of equal values of each key."""
    w = Window.partitionBy(key).orderBy(*ts)
    before = F.lag(value).over(w)
    change = F.when(before.isNull() | (before != F.col(value)), 1).otherwise(0)
    marked = df.withColumn("__change", change).withColumn("run", F.sum("__change").over(w))
    return marked.groupBy(key, F.col(value).alias("state"), "run").agg(F.count("*").alias("length"))


def transitions(df: DataFrame, key: str, ts: list[str], value: str) -> DataFrame:
    """(from_state, to_state, n, p): counts of steps, and their shares of the steps from a state."""
    steps = with_neighbours(df, key, ts, value).where("prev_state is not null")
    counts = steps.groupBy(F.col("prev_state").alias("from_state"), F.col(value).alias("to_state")).agg(
        F.count("*").alias("n")
    )
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def expand_slots(df: DataFrame, start: str, packed: str, step_s: int = 300, drop_unknown: list[str] | None = None) -> DataFrame:
    """One row for each character of a packed day: slot, its time and its character."""
    chars = df.select("*", F.posexplode(F.split(packed, "")).alias("slot", "symbol")).where("symbol != ''")
    if drop_unknown is not None:
        chars = chars.where(F.col("symbol").isin(drop_unknown))
    at = F.timestamp_seconds(F.unix_seconds(F.col(start).cast("timestamp")) + F.col("slot") * step_s)
    return chars.withColumn("slot_ts", at.cast("timestamp_ntz"))
