"""Whole feature tables: all features of a moment and place, and the base panel with the places around."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.functions import calendars, pricing, temporal
from curbflow.operators import joins
from curbflow.operators import spatial as sp

from .joining import IN_INTERVALS, INTERVALS
from .registry import ORACLES, query, table
from .series import base_features
from .spatial import SEGMENTS, XY, places, segments

#: Weather columns, and the type of event whose values stand for them.
READINGS = {"temp_c": "error", "precip_mm": "purchase", "wind_kph": "view", "humidity": "click", "cloud_cover": "signup"}
AVERAGES = ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {n}" for n, t in READINGS.items())
# readings carry Barcelona's winter time, an hour before UTC
WEATHER = f"w AS (SELECT date_trunc('hour', ts) + INTERVAL 30 MINUTE - INTERVAL 1 HOUR AS wts, {AVERAGES} FROM events GROUP BY 1)"
CLUSTERS = ORACLES["sp14_density_clusters"]
NEAREST = ORACLES["j12_nearest"]
DENSITY = ORACLES["j13_stop_density"]


@query(
    "pipeline_all_features",
    f"""WITH {WEATHER}, t AS (SELECT DISTINCT ts FROM events),
        a AS (SELECT t.ts, {", ".join(f"w.{n}" for n in READINGS)}, row_number() OVER (PARTITION BY t.ts ORDER BY abs(epoch_us(t.ts) - epoch_us(w.wts)), w.wts) AS k FROM t JOIN w ON abs(epoch_us(t.ts) - epoch_us(w.wts)) <= 7200000000),
        cl AS ({CLUSTERS}), ne AS ({NEAREST}), de AS ({DENSITY})
        SELECT e.event_id, e.user_id, e.ts, CAST(hour(e.ts) AS INTEGER) AS hour, CAST(isodow(e.ts) - 1 AS INTEGER) AS day_of_week, CAST(month(e.ts) AS INTEGER) AS month,
          CAST(isodow(e.ts) >= 6 AS INTEGER) AS is_weekend, CAST(CAST(e.ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06') AS INTEGER) AS is_public_holiday,
          {", ".join(f"a.{n}" for n in READINGS)}, CAST({IN_INTERVALS.replace("ts ", "e.ts ")} AS INTEGER) AS is_event_ongoing,
          CAST(CAST(e.ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-10', DATE '2024-01-20') AS INTEGER) AS is_event_day,
          cl.cluster, ne.place AS nearest_stop, ne.distance AS stop_distance, coalesce(de.n, 0) AS n_stops
        FROM events e LEFT JOIN a ON e.ts = a.ts AND a.k = 1 LEFT JOIN cl ON e.user_id = cl.vec_id LEFT JOIN ne ON e.user_id = ne.vec_id LEFT JOIN de ON e.user_id = de.vec_id""",
)
def all_features(spark, sf):
    """Calendar, weather as of the moment (readings in local time, moments in UTC), events, the place's cluster and the stops near it, in one table.

    Features of time go to the rows by their timestamp, features of a place are
    worked out once a place and joined by its key.
    """
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    ts = F.col("ts")
    df = events.withColumns(
        {"hour": F.hour(ts), "day_of_week": temporal.day_of_week(ts), "month": F.month(ts), "is_weekend": temporal.weekend_flags(ts)["is_weekend"]}
    )
    df = calendars.with_date_flag(df, ts, calendars.public_holidays(spark, range(2022, 2026), "CT"), "is_public_holiday")
    local = (F.date_trunc("hour", "ts") + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")
    means = [F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6).alias(n) for n, t in READINGS.items()]
    readings = table(spark, sf, "events").groupBy(local.alias("wts")).agg(*means)
    readings = readings.withColumn("wts", temporal.local_to_utc(F.col("wts"))).where("wts is not null")
    df = joins.asof_nearest(df, readings, "ts", "wts", 7200).drop("wts")
    raw = spark.createDataFrame(INTERVALS, "start timestamp_ntz, end timestamp_ntz")
    df = calendars.with_interval_flag(df, "ts", raw.withColumn("end", calendars.whole_day_end(F.col("end"))), "is_event_ongoing")
    df = calendars.with_date_flag(df, ts, raw.select(F.to_date("start").alias("day")), "is_event_day")
    p = places(spark, sf)
    stops = p.select(F.col("vec_id").alias("nearest_stop"), "x", "y")
    near = sp.nearest(p, stops, "vec_id", "nearest_stop", 0.02, other=True)
    density = sp.others_within(p, "vec_id", 0.05).withColumnRenamed("n", "n_stops")
    of_place = (
        sp.density_clusters(p, "vec_id", 0.012, 4)
        .join(near.withColumn("stop_distance", F.round("distance", 6)).drop("distance").hint("merge"), "vec_id", "left")
        .join(density.hint("merge"), "vec_id", "left")
        .withColumnRenamed("vec_id", "user_id")
    )
    out = sp.shuffled_join(df, of_place, "user_id", "left").withColumn("n_stops", F.coalesce("n_stops", F.lit(0).cast("long")))
    return out.select(*events.columns, *[c for c in out.columns if c not in events.columns])


RADII = (0.02, 0.05)
COUNTED = ", ".join(
    f'count(*) FILTER (label = {c} AND d <= {r}) AS "poi_{c}_count_{r * 1000:g}m"' for c in (0, 1) for r in RADII
)
LOGS = ", ".join(
    f'coalesce("poi_{c}_count_{r * 1000:g}m", 0) AS "poi_{c}_count_{r * 1000:g}m", round(ln(1 + coalesce("poi_{c}_count_{r * 1000:g}m", 0)), 6) AS "poi_{c}_count_{r * 1000:g}m_log1p"'
    for c in (0, 1)
    for r in RADII
)


@query(
    "pipeline_poi_features",
    f"""WITH base AS ({ORACLES["pipeline_base_features"]}), poi AS (WITH {SEGMENTS} SELECT seg, {COUNTED} FROM near GROUP BY 1)
        SELECT base.*, {LOGS} FROM base LEFT JOIN poi ON base.user_id = poi.seg""",
)
def poi_features(spark, sf):
    """The base panel with the places around each segment: counted once a segment, joined by its key, with log1p."""
    counts = sp.category_counts(segments(spark, sf), places(spark, sf).select("label", "x", "y"), "seg", "label", [0, 1], list(RADII), unit=1000)
    names = [c for c in counts.columns if "_count_" in c]
    panel = base_features(spark, sf)
    joined = panel.join(counts.select(F.col("seg").alias("user_id"), *names), "user_id", "left").na.fill(0, names)
    logged = pricing.with_log_counts(joined, names)
    return logged.select(*panel.columns, *names, *[F.round(f"{n}_log1p", 6).alias(f"{n}_log1p") for n in names])
