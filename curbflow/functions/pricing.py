"""Tariffs, parking cost, schedules and regulation as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Patterns of the first number in a tariff text (two forms), of a span of hours, of its slots.
FIRST_NUMBER = r"(\d+(?:\.\d+)?)"
LOOSE_NUMBER = r"\d+\.?\d*"
HOUR_SPAN = r"(\d{1,2})(?::\d{2})?\s*-\s*(\d{1,2})(?::\d{2})?"
CLOCK_SPAN = r"(\d{2}:\d{2}-\d{2}:\d{2})"
SPOKEN_SPAN = r"(\d{1,2}:\d{2}\s+a\s+\d{1,2}:\d{2})"


# The codes, labels and units of this and the next function are fixed values.
def tariff_type(code: Column) -> Column:
    return (
        F.when(code.isin("A", "B", "C", "D"), F.concat(F.lit("Blue Zone "), code))
        .when(code == "RES", "Resident")
        .when(code.startswith("GR"), "Green Zone")
        .when(code == "BUFM", "Bus Function/Event")
        .when(code.startswith("BU"), "Bus Zone")
        .when(code.startswith("MA") | code.startswith("MB"), "Motorcycle")
        .when(code.startswith("ED"), "School/Special Zone")
        .when(code == "CYD", "Loading/Unloading (DUM)")
        .otherwise("Unknown")
    )


def tariff_unit(code: Column, fraction_type: Column, max_time: Column) -> Column:
    return (
        F.when(code == "RES", "days")
        .when((code == "CYD") | code.startswith("ED"), "minutes")
        .when(fraction_type == 1, "hours")
        .when(code == "BUFM", "event/hours")
        .when(max_time < 5, "hours")
        .when((max_time > 4) & (max_time <= 30), "minutes")
        .otherwise("unknown")
    )


def charged_units(minutes: Column, unit: Column, min_time: Column, max_time: Column) -> Column:
    """The hours, days or minutes that a stay is charged for; null for an unknown unit."""
    return (
        F.when(unit == "hours", F.least(F.greatest(minutes / 60.0, min_time), max_time))
        .when(unit == "days", F.least(F.greatest(F.ceil(minutes / 1440.0).cast("double"), min_time), max_time))
        .when(unit == "minutes", F.least(F.greatest(minutes.cast("double"), min_time), max_time))
        .when(unit == "event/hours", F.least(minutes / 60.0, max_time))
    )


def price_of_units(units: Column, fraction_type: Column, rate: Column) -> Column:
    """The price before its cap; null for an unknown fraction type."""
    flat = F.when((rate > 0) & (units > 0), rate).otherwise(0.0)
    return F.when(fraction_type.isin(1, 2), rate * units).when(fraction_type == 0, flat)


def with_parking_cost(df: DataFrame, minutes: str, unit: str, name: str = "cost") -> DataFrame:
    """df (minutes, unit, fraction_type, rate, min_time, max_time, max_cost) with the price of a stay in cents-exact decimals.

    Null for an unknown unit or fraction type.  Units and raw price are columns
    of their own projections, so that nothing is worked out twice.
    """
    c = F.col
    priced = df.withColumn("__units", charged_units(c(minutes), c(unit), c("min_time"), c("max_time")))
    priced = priced.withColumn("__raw", F.when(c("__units").isNotNull(), price_of_units(c("__units"), c("fraction_type"), c("rate"))))
    cost = F.when(c(minutes) < 0, 0.0).when(c("__raw").isNotNull(), F.greatest(F.least("__raw", "max_cost"), F.lit(0.0)))
    return priced.withColumn(name, F.round(cost.cast("decimal(20,6)"), 2).cast("decimal(10,2)")).drop("__units", "__raw")


def tariff_amount(text: Column) -> Column:
    """The first number in a tariff text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, FIRST_NUMBER, 1).try_cast("double"), F.lit(0.0))


def tariff_text_features(text: Column) -> dict[str, Column]:
    return {
        "has_tarifa": text.isNotNull(),
        "tarifa_amount": F.regexp_extract(text, LOOSE_NUMBER, 0).try_cast("double"),
        "tarifa_period": F.when(F.lower(text).contains("hora"), "hour").when(text.isNotNull(), "day"),
    }


def schedule_hours(text: Column) -> dict[str, Column]:
    """Start, end and total hours of a text such as `8:00-20:00`; 8 to 20 if it can't be read."""
    whole = F.coalesce(F.upper(text).contains("24H"), F.lit(False))
    start, end = (F.regexp_extract(text, HOUR_SPAN, i).try_cast("int") for i in (1, 2))
    start = F.when(whole, 0).otherwise(F.coalesce(start, F.lit(8)))
    end = F.when(whole, 24).otherwise(F.coalesce(end, F.lit(20)))
    return {"start_hour": start, "end_hour": end, "total_hours": end - start, "is_24h": whole}


def schedule_text_features(text: Column) -> dict[str, Column]:
    ranges = F.regexp_extract_all(text, F.lit(CLOCK_SPAN), 1)
    none = F.array().cast("array<string>")

    def days(mark: str, *names: str) -> Column:
        return F.when(text.contains(mark), F.array(*map(F.lit, names))).otherwise(none)

    return {
        "has_restrictions": F.coalesce(F.size(ranges) > 0, F.lit(False)),
        "restricted_hours": ranges,
        "restricted_days": F.when(
            text.isNotNull(),
            F.concat(
                days("L-V", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday"), days("S", "Saturday"), days("D", "Sunday")
            ),
        ),
    }


#: The days that a day specification stands for, Monday is 0.
DAY_SPECS = {
    "Dl a Dg": range(7),
    "Dl a Ds": range(6),
    "Dl a Dv": range(5),
    "Dilluns": [0],
    "Dimarts": [1],
    "Dimecres": [2],
    "Dijous": [3],
    "Divendres": [4],
    "Dissabte": [5],
    "Diumenges i festius": [6],
    "Diumenges": [6],
    "Dl": [0],
    "Dt": [1],
    "Dc": [2],
    "Dj": [3],
    "Dv": [4],
    "Ds": [5],
    "Dg": [6],
    "festius": [],
}


def seconds_of_day(clock: Column) -> Column:
    """HH:MM as seconds; 24:00 is 86400."""
    parts = F.split(clock, ":")
    return parts[0].cast("int") * 3600 + parts[1].cast("int") * 60


def schedule_parts(schedules: DataFrame) -> DataFrame:
    """(schedule_id, part, spec, slots, applies_holidays, reason): each part of each text, and why it is no rule (null if it is one).

    A text is cut before each day specification (longest first); a part holds
    up to two `HH:MM a HH:MM` slots.  What stands before the first
    specification is a part unless it is blank.  Where a text has no day at all
    its slots are a rule of unknown days, with a null spec.  Null texts have no parts.
    """
    names = "|".join(sorted(DAY_SPECS, key=len, reverse=True)).replace(" ", r"\s+")
    start = rf"(?i)(?:^|(?<=[,;.])\s*)(?:i\s+)?(?:de\s+)?({names})\b"
    text = F.trim(F.regexp_replace("description", r"\s{2,}", " "))
    cut = F.filter(F.split(F.regexp_replace(text, start, "\u0001$1"), "\u0001"), lambda p: F.trim(p) != "")
    parts = schedules.select("schedule_id", "includes_holidays", F.explode(cut).alias("part"), (F.size(cut) == 1).alias("alone"))
    spec = F.lower(F.regexp_replace(F.regexp_extract("part", rf"(?i)^({names})\b", 1), r"\s+", " "))
    parts = parts.withColumns(
        {
            "spec": F.when(spec != "", spec),
            "slots": F.slice(F.regexp_extract_all("part", F.lit(SPOKEN_SPAN), 1), 1, 2),
            "applies_holidays": F.col("includes_holidays").cast("boolean") | F.lower("part").contains("festius"),
        }
    )
    dayless, empty = F.col("spec").isNull(), F.size("slots") == 0
    reason = F.when(dayless & empty, "neither day nor slot").when(empty, "no slot").when(dayless & ~F.col("alone"), "no day")
    return parts.withColumn("reason", reason).drop("includes_holidays", "alone")


def schedule_rules(schedules: DataFrame) -> DataFrame:
    """(schedule_id, days, start_sec, end_sec, applies_holidays) from schedule texts (schedule_id, description, includes_holidays).

    A rule for each slot of each part that is one; days are null where the text names none.
    """
    specs = schedules.sparkSession.createDataFrame([(k.lower(), list(v)) for k, v in DAY_SPECS.items()], "spec string, days array<int>")
    slots = schedule_parts(schedules).where("reason IS NULL").select("schedule_id", "spec", "applies_holidays", F.explode("slots").alias("slot"))
    ends = F.split("slot", r"\s+a\s+")
    return slots.join(F.broadcast(specs), "spec", "left").select(
        "schedule_id",
        "days",
        seconds_of_day(ends[0]).alias("start_sec"),
        seconds_of_day(ends[1]).alias("end_sec"),
        "applies_holidays",
    )


def rejected_parts(schedules: DataFrame) -> DataFrame:
    """(schedule_id, part, reason) of the parts of schedule texts that give no rule."""
    return schedule_parts(schedules).where("reason IS NOT NULL").select("schedule_id", F.trim("part").alias("part"), "reason")


def regulation_status(checks: DataFrame, ts: str, schedule_id: str, rules: DataFrame, schedules: DataFrame, holidays: DataFrame) -> DataFrame:
    """checks with ``status`` at ``ts``.

    rules as of schedule_rules; schedules has (schedule_id, only_inside) and
    holidays one date column.  All three are rule tables, so broadcast; a check
    meets the rules of its own schedule only.  Rules of unknown days decide nothing.
    """
    from .calendars import with_date_flag

    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    per_schedule = rules.where("days IS NOT NULL").groupBy("schedule_id").agg(
        F.collect_list(F.struct("days", "start_sec", "end_sec", "applies_holidays")).alias("rules")
    )
    known = schedules.select("schedule_id", "only_inside").join(per_schedule, "schedule_id", "left")
    known = F.broadcast(known.withColumnRenamed("schedule_id", "__schedule"))
    flagged = with_date_flag(checks, F.col(ts), holidays, "__holiday")
    joined = flagged.join(known, F.col(schedule_id) == F.col("__schedule"), "left")
    hit = F.exists(
        "rules",
        lambda r: F.when(F.col("__holiday") == 1, r["applies_holidays"]).otherwise(F.array_contains(r["days"], F.weekday(ts)))
        & F.when(r["end_sec"] < r["start_sec"], (second >= r["start_sec"]) | (second < r["end_sec"])).otherwise(
            (second >= r["start_sec"]) & (second < r["end_sec"])
        ),
    )
    status = (
        F.when(F.col("rules").isNull(), "Unknown Schedule")
        .when(hit, "Regulated")
        .when(F.col("only_inside"), "Parking Prohibited")
        .otherwise("Unregulated")
    )
    return joined.withColumn("status", status).drop("__holiday", "__schedule", "only_inside", "rules")


def capacity(length_m: Column, per_space: float = 5.0) -> Column:
    """Whole spaces along a kerb."""
    return F.floor(length_m / per_space)


def diversity(counts: list[Column]) -> Column:
    """Shannon entropy of counts (each plus 1e-9)."""
    values = F.array(*[c.cast("double") + 1e-9 for c in counts])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a - x / total * F.ln(x / total))


def density(counts: list[Column]) -> Column:
    out = counts[0]
    for c in counts[1:]:
        out = out + c
    return out


def dynamic_rate(dense: Column, diverse: Column, education: Column, retail: Column) -> Column:
    base = F.least(F.lit(2.0), 1.0 + dense / 50.0) * (1.0 + diverse / 2.0) * 2.0
    rate = base * F.when(education > 3, 1.25).otherwise(1.0) * F.when(retail > 50, 1.5).otherwise(1.0)
    return F.least(F.lit(4.25), rate)


def with_log_counts(df: DataFrame, counts: list[str]) -> DataFrame:
    """Adds log1p and presence of count columns."""
    new = {}
    for c in counts:
        new[f"{c}_log1p"] = F.log1p(c)
        new[f"{c}_present"] = F.col(c) > 0
    return df.withColumns(new)


def tariffs_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        rows,
        "tariff_id int, code string, fraction_type int, min_time double, max_time double, rate double, max_cost double",
    )
