"""Fixtures with exact values for the panel, join, spatial and pricing operators."""

import numbers
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.functions import calendars, pricing, temporal
from curbflow.operators import clean, joins, profile, spatial, timeseries
from curbflow.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def at(text):
    return datetime.fromisoformat(text)


def test_calendar_features(spark):
    rows = [(at("2023-01-01 00:00:00"),), (at("2023-03-15 10:30:00"),), (at("2024-02-29 06:15:00"),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    ts = F.col("ts")
    out = df.select(
        *[c.alias(n) for n, c in temporal.calendar_parts(ts).items()],
        *[c.alias(n) for n, c in temporal.weekend_flags(ts).items()],
        temporal.day_segment(ts).alias("segment"),
        "ts",
    ).orderBy("ts")
    a, b, c = out.collect()
    assert (a["hour"], a["day_of_week"], a["month"], a["is_weekend"], a["is_weekday"], a["segment"]) == (0, 6, 1, 1, 0, "night")
    assert (b["hour"], b["day_of_week"], b["is_weekend"], b["segment"]) == (10, 2, 0, "morning")
    assert (c["year"], c["day_of_year"]) == (2024, 60)
    flagged = calendars.with_date_flag(df, ts, calendars.public_holidays(spark, range(2023, 2025)), "h").orderBy("ts")
    assert [r["h"] for r in flagged.collect()] == [1, 0, 0]


def test_easter():
    assert [calendars.easter(y) for y in (2022, 2023, 2024, 2025)] == [
        date(2022, 4, 17), date(2023, 4, 9), date(2024, 3, 31), date(2025, 4, 20)
    ]


def test_nonexistent_local_time(spark):
    df = spark.createDataFrame([(at("2023-03-26 02:30:00"),), (at("2023-07-01 12:00:00"),)], "ts timestamp_ntz")
    got = [r["u"] for r in df.orderBy("ts").select(temporal.local_to_utc(F.col("ts")).alias("u")).collect()]
    assert got == [None, at("2023-07-01 10:00:00")]


def test_resample(spark):
    rows = [
        (1, at("2022-01-01 00:00:53"), 3), (1, at("2022-01-01 00:05:54"), 4), (1, at("2022-01-01 00:21:00"), 5),
        (2, at("2022-01-01 00:10:00"), 1), (2, at("2022-01-01 00:14:59"), 2),
    ]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, v int")
    got = [(r["id"], r["ts"].minute, r["v"]) for r in timeseries.resample_ffill(df, "id", "ts", "v").orderBy("id", "ts").collect()]
    assert got == [(1, 0, None), (1, 5, 3), (1, 10, 4), (1, 15, 4), (1, 20, 4), (2, 10, 1)]
    assert timeseries.resample_ffill(df.limit(0), "id", "ts", "v").count() == 0


def test_resample_over_months(spark):
    df = spark.createDataFrame([(1, at("2022-01-31 23:50:00"), 7), (1, at("2022-02-01 00:12:00"), 8)], "id long, ts timestamp_ntz, v int")
    whole = [r["v"] for r in timeseries.resample_ffill(df, "id", "ts", "v").orderBy("ts").collect()]
    assert whole == [7, 7, 7, 7, 7]
    monthly = [r["v"] for r in timeseries.resample_ffill(df, "id", "ts", "v", reset_monthly=True).orderBy("ts").collect()]
    assert monthly == [7, None]


HOURS = [(at(f"2023-03-15 {h:02}:00:00"), t) for h, t in ((8, 12.0), (9, 14.0), (10, 16.0))]


@pytest.mark.parametrize("how", ["tolerance", "unbounded"])
def test_asof(spark, how):
    times = ["08:05", "08:55", "10:10", "11:00", "08:30", "13:00"]
    left = spark.createDataFrame([(at(f"2023-03-15 {t}:00"),) for t in times], "ts timestamp_ntz")
    right = spark.createDataFrame(HOURS, "hour timestamp_ntz, temp double")
    if how == "tolerance":
        got = joins.asof_nearest(left, right, "ts", "hour", 3600)
        last = None
    else:
        got = joins.asof_nearest_unbounded(left, right, "ts", "hour")
        last = 16.0
    want = dict(zip([at(f"2023-03-15 {t}:00") for t in times], [12.0, 14.0, 16.0, 16.0, 12.0, last], strict=True))
    assert {r["ts"]: r["temp"] for r in got.collect()} == want


def test_event_intervals(spark):
    events = [
        ("2023-03-15T10:00:00", "2023-03-15T18:00:00"), ("2023-03-20T00:00:00", "2023-03-22T23:59:59"),
        ("2023-03-25T00:00:00", "2023-03-25T00:00:00"), ("2023-03-28T22:00:00", "2023-03-29T02:00:00"),
    ]
    raw = spark.createDataFrame([(at(a), at(b)) for a, b in events], "start timestamp_ntz, end timestamp_ntz")
    intervals = raw.withColumn("end", calendars.whole_day_end(F.col("end")))
    targets = ["03-15 09", "03-15 12", "03-15 18", "03-15 19", "03-21 12", "03-25 15", "03-28 23", "03-29 01", "04-01 10"]
    df = spark.createDataFrame([(at(f"2023-{t}:00:00"),) for t in targets], "ts timestamp_ntz")
    got = calendars.with_interval_flag(df, "ts", intervals, "on").orderBy("ts")
    assert [r["on"] for r in got.collect()] == [0, 1, 1, 0, 1, 1, 1, 1, 0]
    none = calendars.with_interval_flag(df, "ts", intervals.limit(0), "on")
    assert {r["on"] for r in none.collect()} == {0}


STOPS = [("S1", 41.390205, -73.984472), ("S2", 41.391205, -73.985472), ("S3", 40.758896, -73.985130), ("P1", None, None)]
PLACES = [(1, 41.390200, -73.984400), (2, 41.390800, -73.985000), (3, 40.750000, -73.980000)]


def projected(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key}, lat double, lon double").where("lat is not null")
    x, y = spatial.utm(F.col("lon"), F.col("lat"))
    return df.withColumns({"x": x, "y": y})


def test_transit(spark):
    stops, places = projected(spark, STOPS, "stop string"), projected(spark, PLACES, "id long")
    got = {r["id"]: r for r in spatial.nearest(places, stops, "id", "stop", 500.0).collect()}
    assert [round(got[i]["distance"], 1) for i in (1, 2, 3)] == [8.8, 87.5, 1595.2]
    line = F.array(F.struct("x", "y"), F.struct("x", "y"))
    near = spatial.pairs_within(places.select("id", line.alias("line")), stops.select("stop", "x", "y"), 500.0)
    assert {r["id"]: r["count"] for r in near.groupBy("id").count().collect()} == {1: 2, 2: 2}


def test_nearest_of_places_without_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    where = [(1.0, 1.0), (1.0, 1.0), (-3.0, 2.0), (40.0, 40.0), (None, 0.0), (0.0, None), (nan, 0.0), (0.0, inf)]
    stops = spark.createDataFrame([(i, *p) for i, p in enumerate(where)], "stop long, x double, y double")
    asked = [(0.9, 1.0), (0.9, 1.0), (-1.0, 1.5), (5000.0, 5000.0), (1e200, 0.0), (None, 1.0), (nan, 1.0), (1.0, -inf)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "id long, x double, y double")
    got = {r["id"]: (r["stop"], r["distance"]) for r in spatial.nearest(points, stops, "id", "stop", 0.5).collect()}
    want = {}
    for i, (x, y) in enumerate(asked):
        usable = x is not None and np.isfinite([x, y]).all()
        d = sorted((float(np.hypot(x - a, y - b)), k) for k, (a, b) in enumerate(where[:4])) if usable else [(None, None)]
        want[i] = d[0][::-1]
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in want.items()}
    assert all(want[i][1] == pytest.approx(d) if d is not None else want[i][1] is None for i, (_, d) in got.items())
    none = spatial.nearest(points, stops.limit(0), "id", "stop", 0.5)
    assert [(r["stop"], r["distance"]) for r in none.collect()] == [(None, None)] * 8


def test_nearest_other_place(spark):
    where = [(0.0, 0.0), (0.0, 0.0), (0.3, 0.0), (9.0, 9.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(where)], "id long, x double, y double")
    got = {r["id"]: (r["place"], round(r["distance"], 6)) for r in spatial.nearest(rows, rows.withColumnRenamed("id", "place"), "id", "place", 0.1, other=True).collect()}
    assert got == {0: (1, 0.0), 1: (0, 0.0), 2: (0, 0.3), 3: (2, round(float(np.hypot(8.7, 9)), 6))}
    alone = rows.where("id = 3")
    assert [r["place"] for r in spatial.nearest(alone, alone.withColumnRenamed("id", "place"), "id", "place", 0.1, other=True).collect()] == [None]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    values = {g: rng.integers(0, 50, n).astype(float).tolist() for g, n in (("a", 1), ("b", 2), ("c", 1001), (None, 40))}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("d", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in profile.exact_quantiles(df, "v", shares, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    assert all(np.allclose(got[g], np.quantile(values[g], shares)) for g in got)
    every = profile.exact_quantiles(df, "v", shares).collect()
    assert np.allclose(every[0]["quantiles"], np.quantile(sum(values.values(), []), shares))
    assert profile.exact_quantiles(df.where("v is null"), "v", [0.5]).collect()[0]["quantiles"] == [None]


def test_rejected_geometry(spark):
    nan = float("nan")
    cases = [(None, "no coordinates"), ([], "no coordinates"), ([[0.0, 1.0]], "too few points"), ([[0.0, 1.0], [nan, 1.0]], "not finite"),
             ([[1.0, 1.0], [1.0, 1.0]], "no length"), ([[1.0, 1.0], [2.0, None], [3.0, 1.0]], "usable")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<array<double>>")
    line, reason = spatial.repaired_line(F.col("c"))
    got = {r["i"]: (r["reason"], r["line"]) for r in df.select("i", reason.alias("reason"), line.alias("line")).collect()}
    assert [got[i][0] for i in range(6)] == [r for _, r in cases]
    assert len(got[5][1]) == 2 and got[4][1] is None


def test_density_clusters(spark):
    rows = [
        (1, 40.7128, -74.0060), (2, 40.7129, -74.0061), (3, 40.7130, -74.0059), (4, 40.7580, -73.9850),
        (5, 40.7581, -73.9851), (6, 40.8000, -73.9000), (7, 40.8500, -73.8000), (8, 34.0522, -118.2437),
    ]
    got = spatial.density_clusters(projected(spark, rows, "id long").drop("lat", "lon"), "id", 1000.0, 2)
    assert {r["id"]: r["cluster"] for r in got.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: -1, 7: -1, 8: -1}
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert spatial.density_clusters(one, "id", 10.0, 2).first()["cluster"] == -1
    assert spatial.density_clusters(one.limit(0), "id", 10.0, 2).count() == 0


def test_geometry_cases(spark):
    cases = {
        "line": [[0.0, 0.0], [1.0, 1.0]], "one bad": [[0.0, 0.0], [1.0]], "one": [[0.0, 0.0]], "empty": [], "none": None,
    }
    df = spark.createDataFrame(list(cases.items()), "name string, c array<array<double>>")
    got = {r["name"]: r["l"] for r in df.select("name", spatial.usable_line(F.col("c")).alias("l")).collect()}
    assert [n for n, v in got.items() if v is not None] == ["line"]


def test_schedule_status(spark):
    schedules = spark.createDataFrame([(1, "de Dl a Dv de 09:00 a 14:00 i de 16:00 a 20:00; Ds de 09:00 a 14:00", 0, False)],
                                      "schedule_id int, description string, includes_holidays int, only_inside boolean")
    times = ["2024-05-13 10:00", "2024-05-13 15:00", "2024-05-13 23:00", "2024-05-18 10:00", "2024-05-18 17:00", "2024-05-19 10:00", "2024-08-15 11:00"]
    checks = spark.createDataFrame([(at(t + ":00"), 1) for t in times] + [(at(times[0] + ":00"), 9)], "ts timestamp_ntz, s int")
    holidays = calendars.public_holidays(spark, range(2024, 2025), "CT")
    got = pricing.regulation_status(checks, "ts", "s", pricing.schedule_rules(schedules), schedules, holidays).orderBy("s", "ts")
    reg, un = "Regulated", "Unregulated"
    assert [r["status"] for r in got.collect()] == [reg, un, un, reg, un, un, un, "Unknown Schedule"]


def test_keep_one_and_stitching(spark):
    df = spark.createDataFrame([("f", 0, "a", None), ("f", 1, None, "x"), ("f", 2, "b", "y"), ("f", 3, "c", None), ("f", 4, "d", None)], "file string, i int, h string, b string")
    assert [(r["h"], r["b"]) for r in clean.stitched(df, "i", "h", "b").orderBy("i").collect()] == [("a", "x"), ("b", "y")]
    first = clean.keep_one(df, ["file"], [F.desc("i")]).first()
    assert first["i"] == 4


def test_many_to_one_refuses_repeats(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        joins.many_to_one(df, df, "k")


def comparable(v):
    """A value as text, alike for both engines."""
    if isinstance(v, numbers.Number | Decimal) and not isinstance(v, bool):
        return str(v) if isinstance(v, int) and abs(v) >= 10**6 else f"{float(v) + 0.0:.6g}"
    if isinstance(v, list | tuple):
        return str([comparable(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_its_oracles_rows(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    got = got.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(tuple(map(comparable, r)) for r in got) == sorted(tuple(map(comparable, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
