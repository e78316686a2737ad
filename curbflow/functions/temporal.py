"""Calendar and clock features as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_timestamp(c: Column) -> Column:
    """yyyyMMddHHmmss text as a local timestamp; null where it isn't one."""
    return F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def day_first_timestamp(c: Column) -> Column:
    """dd/MM/yyyy HH:mm:ss text as a local timestamp; null where it isn't one."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")


def epoch_millis_timestamp(c: Column) -> Column:
    return F.timestamp_millis(c).cast("timestamp_ntz")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day_of_week": day_of_week(ts),
        "day": F.dayofmonth(ts),
        "day_of_year": F.dayofyear(ts),
        "iso_week": F.weekofyear(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
    }


def calendar_names(ts: Column) -> dict[str, Column]:
    return {"day_name": F.date_format(ts, "EEEE"), "month_name": F.date_format(ts, "MMMM")}


def weekend_flags(ts: Column) -> dict[str, Column]:
    weekend = day_of_week(ts) >= 5
    return {"is_weekend": weekend.cast("int"), "is_weekday": (~weekend).cast("int")}


def cyclical(ts: Column, month_zero_based: bool = False) -> dict[str, Column]:
    """Sine and cosine of hour, day of week and month on their circles."""
    month = F.month(ts) - (1 if month_zero_based else 0)
    out = {}
    for name, value, period in (("hour", F.hour(ts), 24), ("dow", day_of_week(ts), 7), ("month", month, 12)):
        angle = value * F.lit(2 * pi) / period
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return out


def bucketed(value: Column, edges: list[int], labels: list[str], closed: str = "left") -> Column:
    """The label of the bin between two edges; with closed="right" the first bin also holds its left edge."""
    case = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        if closed == "left":
            inside = (value >= low) & (value < high)
        else:
            inside = ((value > low) | ((value == low) & F.lit(low == edges[0]))) & (value <= high)
        case = F.when(inside, label).otherwise(case)
    return case


def day_segment(ts: Column) -> Column:
    return bucketed(F.hour(ts), [0, 6, 12, 18, 24], ["night", "morning", "afternoon", "evening"])


def day_segment_right(ts: Column) -> Column:
    return bucketed(F.hour(ts), [0, 6, 12, 18, 24], ["Night", "Morning", "Afternoon", "Evening"], closed="right")


def rush_hour_segment(ts: Column) -> Column:
    labels = ["Night", "Morning Rush", "Daytime", "Evening Rush", "Evening"]
    return bucketed(F.hour(ts), [0, 6, 10, 16, 20, 24], labels)


def season(ts: Column) -> Column:
    third = F.floor(F.pmod(F.month(ts), F.lit(12)) / 3)
    return F.element_at(F.array(*map(F.lit, ("Winter", "Spring", "Summer", "Autumn"))), (third + 1).cast("int"))


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def local_to_utc(ts: Column, zone: str = "Europe/Madrid") -> Column:
    """UTC of a local time; null for local times that the clock change leaves out."""
    utc = F.to_utc_timestamp(ts, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == ts.cast("timestamp"), utc.cast("timestamp_ntz"))
