"""Queries of readers and writers: tables are landed as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from curbflow.functions.temporal import compact_timestamp
from curbflow.sources import landing
from curbflow.sources.scratch import new_folder

from .registry import query, table


def landing_folder(spark: SparkSession) -> str:
    return new_folder(spark, "landed")


def landed_history(spark, sf) -> str:
    folder = landing_folder(spark)
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("int").alias("idTram"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("data"),
        (F.col("o_orderkey") % 7).cast("int").alias("estatActual"),
        (F.col("o_orderkey") % 5).cast("int").alias("estatPrevist"),
    )
    o.write.option("header", True).csv(folder)
    return folder


@query(
    "io1_csv_scan",
    "SELECT o_custkey AS segment_id, o_orderdate AS ts, CAST(o_orderkey % 7 AS INTEGER) AS state FROM orders",
)
def io1(spark, sf):
    rows = landing.read_history(spark, landed_history(spark, sf))
    return rows.select(F.col("segment_id").cast("long").alias("segment_id"), compact_timestamp(F.col("raw_ts")).alias("ts"), "state")


@query(
    "io3_bad_lines",
    "SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS n_good, count(*) FILTER (o_orderkey % 10 = 0) AS n_bad FROM orders",
)
def io3(spark, sf):
    folder = landing_folder(spark)
    o = table(spark, sf, "orders")
    line = F.when(F.col("o_orderkey") % 10 == 0, "x,broken").otherwise(F.concat_ws(",", "o_custkey", F.lit("20240101000000"), F.lit("1"), F.lit("2")))
    o.select(line.alias("value")).write.text(folder)
    bad = F.col("_corrupt_record").isNotNull()
    return landing.read_lines(spark, folder, landing.HISTORY_SCHEMA).agg(F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad"))


def landed_predictions(spark, o) -> str:
    """A folder of answers with o's (key, segment, tariff, start, slots), in the nesting of the prediction service."""
    folder = landing_folder(spark)
    properties = F.struct(
        F.col("segment").alias("ID_TRAMO"), F.col("key").cast("string").alias("TRAMO"), F.lit("x").alias("TIPO"), F.col("tariff").alias("TARIFA"),
        F.lit("h").alias("HORARIO"), F.col("slots").alias("PREDICCIONES"),
    )
    parts = F.array(F.struct(F.array(F.struct(properties.alias("properties"))).alias("features")))
    record = F.struct(F.date_format("start", "dd/MM/yyyy HH:mm:ss").alias("FH_INICIO"), parts.alias("TRAMOS"))
    # a day's records, a thousandth of them a line, so that no line holds a whole day
    lines = o.groupBy(F.to_date("start").alias("day"), F.pmod(F.xxhash64("key"), F.lit(1000)).alias("part"))
    lines.agg(F.collect_list(record).alias("OPENDATA_PSIU_APPARKB")).drop("day", "part").write.json(folder)
    return folder


@query(
    "io4_prediction_json",
    """SELECT o_orderkey AS "ID_TRAMO", strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS "FH_INICIO", o_orderpriority AS "PREDICCIONES" FROM orders""",
)
def io4(spark, sf):
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(key.alias("key"), key.alias("segment"), F.lit("a").alias("tariff"), F.col("o_orderdate").alias("start"), F.col("o_orderpriority").alias("slots"))
    return landing.read_predictions(spark, landed_predictions(spark, o), multi_line=False).select("ID_TRAMO", "FH_INICIO", "PREDICCIONES")


@query(
    "io6_parquet_columns",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'",
)
def io6(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


@query(
    "io9_monthly_parquet",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2",
)
def io9(spark, sf):
    folder = landing_folder(spark)
    landing.write_monthly(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", folder)
    return spark.read.parquet(folder).where("year = 1997").groupBy("year", "month").agg(F.count("*").alias("n"))


@query(
    "io11_feature_sets",
    "SELECT user_id, count(*) AS n, CAST(hour(max(ts)) AS INTEGER) AS last_hour FROM events GROUP BY 1",
)
def io11(spark, sf):
    folder = landing_folder(spark)
    by_user = table(spark, sf, "events").groupBy("user_id")
    sets = {"counts": by_user.agg(F.count("*").alias("n")), "clock": by_user.agg(F.hour(F.max("ts")).alias("last_hour"))}
    landing.write_feature_sets(sets, folder)
    return spark.read.parquet(f"{folder}/counts").join(spark.read.parquet(f"{folder}/clock"), "user_id", "left")


@query("io13_landed_columns", "SELECT 'extra' AS missing, count(*) AS n_rows FROM orders")
def io13(spark, sf):
    files = landing.landed_columns(spark, landed_history(spark, sf), ["idTram", "data", "extra"])
    return files.groupBy("missing").agg(F.sum("n_rows").alias("n_rows"))


@query(
    "io5_forecast_json",
    """SELECT o_orderdate AS ts, round(avg(o_totalprice), 4) AS temp_c, o_orderstatus AS condition FROM orders GROUP BY 1, 3""",
)
def io5(spark, sf):
    folder = landing_folder(spark)
    o = table(spark, sf, "orders")
    daily = o.groupBy("o_orderdate", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("t"))
    hour = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("time"),
        F.col("t").alias("temp_c"),
        F.struct(F.col("o_orderstatus").alias("text")).alias("condition"),
    )
    days = F.collect_list(F.struct(F.array(hour).alias("hour")))
    by_month = daily.groupBy("o_orderstatus", F.date_trunc("month", "o_orderdate").alias("month"))
    by_month.agg(F.struct(days.alias("forecastday")).alias("forecast")).select("forecast").write.json(folder)
    return landing.read_forecast(spark, folder, multi_line=False).select("ts", "temp_c", "condition")


@query("io7_gtfs", "SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST((o_orderkey % 30) * 3600 AS INTEGER) AS arrival_s FROM orders")
def io7(spark, sf):
    folder = landing_folder(spark)
    clock = F.concat(F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit(":00:00"))
    times = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("trip_id"), F.col("o_custkey").cast("string").alias("stop_id"), clock.alias("arrival_time")
    )
    times.write.option("header", True).csv(f"{folder}/stop_times.txt")
    read = landing.read_csv(spark, f"{folder}/stop_times.txt", landing.GTFS_SCHEMAS["stop_times"])
    return read.select("trip_id", landing.gtfs_seconds(F.col("arrival_time")).alias("arrival_s"))


@query("io14_api_records", "SELECT c_custkey AS id, c_name AS name FROM customer")
def io14(spark, sf):
    folder = landing_folder(spark)
    c = table(spark, sf, "customer").select("c_nationkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("r"))
    # a nation's records, a thousandth of them a line, so that no line grows without bound
    by_nation = c.groupBy("c_nationkey", F.pmod(F.xxhash64("r.id"), F.lit(1000)).alias("part"))
    by_nation.agg(F.struct(F.collect_list("r").alias("records")).alias("result")).select("result").write.json(folder)
    return landing.read_records(spark, folder, "id: BIGINT, name: STRING", multi_line=False)


@query(
    "io2_months_by_name",
    """SELECT o_custkey AS segment_id, o_orderdate AS ts, CAST(o_orderkey % 7 AS INTEGER) AS state FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-11-01' AND o_orderdate < TIMESTAMP '1997-03-01'""",
)
def io2(spark, sf):
    """Monthly folders of history files; only those whose name lies in the range are listed and read."""
    folder = landing_folder(spark)
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("int").alias("idTram"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("data"),
        (F.col("o_orderkey") % 7).cast("int").alias("estatActual"),
        (F.col("o_orderkey") % 5).cast("int").alias("estatPrevist"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )
    o.write.option("header", True).partitionBy("month").csv(folder)
    rows = landing.read_months(spark, folder, "1996-11", "1997-02")
    return rows.select(F.col("segment_id").cast("long").alias("segment_id"), compact_timestamp(F.col("raw_ts")).alias("ts"), "state")


@query(
    "io2_history_files",
    """SELECT o_custkey AS segment_id, o_orderdate AS ts, CAST(o_orderkey % 7 AS INTEGER) AS state, strftime(o_orderdate, '%Y_%m') AS file_month FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-11-01' AND o_orderdate < TIMESTAMP '1997-03-01'""",
)
def io2_files(spark, sf):
    """History files named by month, in one folder; the file system lists those of the range, and only they are opened."""
    folder, parts = landing_folder(spark), landing_folder(spark)
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("int").alias("idTram"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("data"),
        (F.col("o_orderkey") % 7).cast("int").alias("estatActual"),
        (F.col("o_orderkey") % 5).cast("int").alias("estatPrevist"),
        F.date_format("o_orderdate", "yyyy_MM").alias("month"),
    )
    o.repartition("month").write.option("header", True).partitionBy("month").csv(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for i, file in enumerate(fs.globStatus(path(f"{parts}/month=*/part-*.csv"))):  # a name for each landed file
        month = file.getPath().getParent().getName().removeprefix("month=")
        fs.rename(file.getPath(), path(f"{folder}/{month}_{i}_TRAMS_TRAMS.csv"))
    rows = landing.read_history(spark, folder, "1996-11", "1997-02")
    return rows.select(
        F.col("segment_id").cast("long").alias("segment_id"), compact_timestamp(F.col("raw_ts")).alias("ts"), "state", F.substring("file_name", 1, 7).alias("file_month")
    )


@query(
    "io3_rejected_lines",
    """SELECT strftime(o_orderdate, '%Y') AS year, count(*) FILTER (o_orderkey % 10 NOT IN (0, 1)) AS n_good, count(*) FILTER (o_orderkey % 10 IN (0, 1)) AS n_bad,
       CAST(coalesce(sum(o_custkey) FILTER (o_orderkey % 10 NOT IN (0, 1)), 0) AS BIGINT) AS sum_good FROM orders GROUP BY 1""",
)
def io3_rejects(spark, sf):
    """CSV with a header, a fifth of its lines malformed: too few fields, or a word where a number belongs."""
    folder = landing_folder(spark)
    o, last = table(spark, sf, "orders"), F.col("o_orderkey") % 10
    text = F.col("o_custkey").cast("string")
    rest = F.concat_ws(",", F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("1"), F.lit("2"))
    line = F.when(last == 0, "x,broken").when(last == 1, F.concat_ws(",", F.lit("none"), rest)).otherwise(F.concat_ws(",", text, rest))
    header = ",".join(f.split()[0] for f in landing.HISTORY_SCHEMA.split(", "))
    # the header is the one column's name, written without quotes or escapes
    o.select(line.alias(header), F.year("o_orderdate").alias("year")).write.options(header=True, sep="\u0001", quote="").partitionBy("year").csv(folder)
    rows = landing.read_marked(spark, folder, landing.HISTORY_SCHEMA + ", year STRING")
    bad = F.col(landing.CORRUPT).isNotNull()
    return rows.groupBy("year").agg(
        F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad"), F.coalesce(F.sum(F.when(~bad, F.col("idTram"))), F.lit(0)).alias("sum_good")
    )


@query(
    "io10_report_csv",
    "SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1",
)
def io10_report(spark, sf):
    folder = landing_folder(spark)
    report = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"))
    landing.write_report(report.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")), folder)
    return landing.read_csv(spark, folder, "priority STRING, n BIGINT, mean_price DOUBLE")
