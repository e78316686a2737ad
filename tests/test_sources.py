"""Readers on small landed files."""

import json

from pyspark.sql import functions as F

from curbflow.functions.temporal import compact_timestamp
from curbflow.sources import landing

HEAD = "idTram,data,estatActual,estatPrevist\n"


def test_history_is_chosen_by_file_name(spark, tmp_path):
    for month, day in (("2022_01", "20220105000053"), ("2022_02", "20220205000053"), ("2022_03", "bad")):
        (tmp_path / f"{month}_GENER_TRAMS_TRAMS.csv").write_text(HEAD + f"1,{day},3,2\nx,y\n")
    rows = landing.read_history(spark, str(tmp_path), start="2022-02", end="2022-03").orderBy("file_name")
    got = rows.withColumn("ts", compact_timestamp(F.col("raw_ts"))).collect()
    assert [(r["segment_id"], r["state"], r["ts"] is None) for r in got] == [(1, 3, False), (1, 3, True)]


def test_missing_columns_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("idTram,data\n1,2\n2,3\n")
    (tmp_path / "b.csv").write_text("idTram,data,extra\n1,2,3\n")
    got = {r["file_name"]: (r["missing"], r["n_rows"]) for r in landing.landed_columns(spark, str(tmp_path), ["data", "extra"]).collect()}
    assert got == {"a.csv": ("extra", 2), "b.csv": ("", 1)}
    (tmp_path / "c.txt").write_text("1,20220101000000,3,4\nx,y\n")
    lines = landing.read_lines(spark, str(tmp_path / "c.txt"), landing.HISTORY_SCHEMA)
    assert sorted(r["_corrupt_record"] or "" for r in lines.collect()) == ["", "x,y"]


def test_forecast_and_predictions(spark, tmp_path):
    hours = [{"time": f"2023-03-15 0{h}:00", "temp_c": t, "condition": {"text": "Sunny"}, "humidity": 60} for h, t in ((8, 12.0), (9, 14.0))]
    (tmp_path / "w.json").write_text(json.dumps({"forecast": {"forecastday": [{"date": "2023-03-15", "hour": hours}]}}, indent=1))
    got = landing.read_forecast(spark, str(tmp_path / "w.json")).orderBy("ts").collect()
    assert [(r["ts"].hour, r["temp_c"], r["condition"]) for r in got] == [(8, 12.0, "Sunny"), (9, 14.0, "Sunny")]
    feature = {"properties": {"ID_TRAMO": 7, "TARIFA": "a", "PREDICCIONES": "0123"}, "geometry": None}
    record = {"FH_INICIO": "17/09/2024 00:00:00", "TRAMOS": [{"features": [feature, feature]}]}
    (tmp_path / "p.json").write_text(json.dumps({"OPENDATA_PSIU_APPARKB": [record]}))
    assert [r["ID_TRAMO"] for r in landing.read_predictions(spark, str(tmp_path / "p.json")).collect()] == [7, 7]


def test_gtfs(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\nS1,One,41.39,2.17\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,arrival_time\nT1,S1,25:10:00\n")
    (tmp_path / "trips.txt").write_text("trip_id,route_id\nT1,R1\n")
    (tmp_path / "routes.txt").write_text("route_id,route_short_name\nR1,V15\n")
    (tmp_path / "calendar.txt").write_text("service_id,start_date,end_date\nW,20240101,20241231\n")
    tables = landing.read_gtfs(spark, str(tmp_path))
    assert tables["stops"].first()["stop_lat"] == 41.39
    assert tables["stop_times"].select(landing.gtfs_seconds(F.col("arrival_time")).alias("s")).first()["s"] == 90600


def test_reports_and_monthly_files(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-05 00:00:00' AS ts, 1 AS v UNION ALL SELECT timestamp_ntz'2024-02-05 00:00:00', 2")
    landing.write_monthly(df, "ts", str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("month = 2").first()["v"] == 2
    landing.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
