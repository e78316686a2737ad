"""Readers and writers of landed files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = "idTram INT, data STRING, estatActual INT, estatPrevist INT"
FORECAST_SCHEMA = (
    "forecast STRUCT<forecastday: ARRAY<STRUCT<date: STRING, hour: ARRAY<STRUCT<time: STRING, temp_c: DOUBLE, "
    "condition: STRUCT<text: STRING, code: INT>, wind_kph: DOUBLE, precip_mm: DOUBLE, humidity: INT, cloud: INT>>>>>"
)
PREDICTION_SCHEMA = (
    "OPENDATA_PSIU_APPARKB ARRAY<STRUCT<FH_INICIO: STRING, TRAMOS: ARRAY<STRUCT<features: ARRAY<STRUCT<"
    "properties: STRUCT<ID_TRAMO: BIGINT, TRAMO: STRING, TIPO: STRING, TARIFA: STRING, HORARIO: STRING, PREDICCIONES: STRING>>>>>>>"
)
GTFS_SCHEMAS = {
    "stops": "stop_id STRING, stop_name STRING, stop_lat DOUBLE, stop_lon DOUBLE",
    "stop_times": "trip_id STRING, stop_id STRING, arrival_time STRING",
    "trips": "trip_id STRING, route_id STRING",
    "routes": "route_id STRING, route_short_name STRING",
    "calendar": "service_id STRING, start_date STRING, end_date STRING",
}


#: Where a line that doesn't parse is kept whole.
CORRUPT = "_corrupt_record"


def whole_lines(spark: SparkSession, path: str | list[str], schema: str, folder_columns: str = "") -> DataFrame:
    """CSV with a header and `_corrupt_record`.

    The reader converts only the columns that a query refers to, and marks a
    line only for those; the filter, which holds always, refers to all of them.
    """
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = spark.read.options(**options).schema(f"{schema}, {CORRUPT} STRING{folder_columns}").csv(path)
    return rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1)) == 0)


def read_marked(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header: the schema's columns, `_corrupt_record` (the whole line where it doesn't parse) and file_name.

    A line doesn't parse if it has another number of fields than the header or
    a field that isn't of its type.  Whole lines are parsed whatever columns are asked for.
    """
    return whole_lines(spark, path, schema).select("*", F.col("_metadata.file_name").alias("file_name"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The lines of CSV with a header that parse; ``rejected_lines`` has the others."""
    return read_marked(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file_name")


def rejected_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file_name, line): the side table of what ``read_csv`` leaves out."""
    return read_marked(spark, path, schema).where(F.col(CORRUPT).isNotNull()).select("file_name", F.col(CORRUPT).alias("line"))


def line_counts(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file_name, n_good, n_bad) of each file of CSV with a header; a file without lines below its header has no row."""
    bad = F.col(CORRUPT).isNotNull()
    return read_marked(spark, path, schema).groupBy("file_name").agg(F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad"))


def files_of_months(spark: SparkSession, folder: str, start: str, end: str) -> list[str]:
    """Paths of the monthly history files (YYYY_MM_..._TRAMS_TRAMS.csv) of a folder from ``start`` to ``end`` (YYYY-MM).

    The file system lists the folder by one pattern a year; names outside the
    range, and names of another form, are left out.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for year in range(int(start[:4]), int(end[:4]) + 1):
        pattern = hadoop.Path(f"{folder}/{year}_[0-9][0-9]_*_TRAMS_TRAMS.csv")
        statuses = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        found += [(f"{year}-{s.getPath().getName()[5:7]}", s.getPath().toString()) for s in statuses]
    return sorted(path for month, path in found if start <= month <= end)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of CSV without a header; `_corrupt_record` holds a line that doesn't parse, to be counted and dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_csv("value", F.lit(f"{schema}, _corrupt_record STRING"), options)
    return spark.read.text(path).select(parsed.alias("r")).select("r.*")


def read_history(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(segment_id, raw_ts, state, file_name) of monthly files.

    With ``start`` and ``end`` (YYYY-MM) ``path`` is a folder whose files of
    these months, chosen by name, are all that is opened; without any there are no rows.
    """
    if (start is None) != (end is None):
        raise ValueError("a range of months needs both ends")
    paths = path if start is None else files_of_months(spark, path, start, end)
    if paths:
        rows = read_marked(spark, paths, HISTORY_SCHEMA).where(F.col(CORRUPT).isNull())
    else:
        rows = spark.createDataFrame([], f"{HISTORY_SCHEMA}, file_name STRING")
    return rows.select(F.col("idTram").alias("segment_id"), F.col("data").alias("raw_ts"), F.col("estatActual").alias("state"), "file_name")


def read_months(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """The history of the months from ``start`` to ``end`` (YYYY-MM) of a folder with one part a month (month=YYYY-MM).

    The month is in the path, so files of other months aren't opened.
    """
    rows = whole_lines(spark, folder, HISTORY_SCHEMA, ", month STRING").where((F.col("month") >= start) & (F.col("month") <= end) & F.col(CORRUPT).isNull())
    return rows.select(F.col("idTram").alias("segment_id"), F.col("data").alias("raw_ts"), F.col("estatActual").alias("state"), "month")


def read_predictions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row for each segment of each record, properties flattened; a file holds one answer, or one in each line."""
    raw = spark.read.schema(PREDICTION_SCHEMA).option("multiLine", multi_line).json(path)
    records = raw.select(F.explode("OPENDATA_PSIU_APPARKB").alias("r"))
    parts = records.select(F.col("r.FH_INICIO").alias("FH_INICIO"), F.explode("r.TRAMOS").alias("t"))
    return parts.select("FH_INICIO", F.explode("t.features").alias("f")).select("FH_INICIO", "f.properties.*")


def read_forecast(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row for each forecast hour; a file holds one answer, or one in each line."""
    raw = spark.read.schema(FORECAST_SCHEMA).option("multiLine", multi_line).json(path)
    hours = raw.select(F.explode("forecast.forecastday").alias("d")).select(F.explode("d.hour").alias("h"))
    return hours.select(
        F.try_to_timestamp("h.time", F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("ts"),
        "h.temp_c",
        F.col("h.condition.text").alias("condition"),
        "h.wind_kph",
        "h.precip_mm",
        "h.humidity",
        "h.cloud",
    )


def read_records(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Rows of landed API answers: {"result": {"records": [...]}}."""
    raw = spark.read.schema(f"result STRUCT<records: ARRAY<STRUCT<{schema}>>>").option("multiLine", multi_line).json(path)
    return raw.select(F.explode("result.records").alias("r")).select("r.*")


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{name}.txt", schema) for name, schema in GTFS_SCHEMAS.items()}


def gtfs_seconds(clock: Column) -> Column:
    """HH:MM:SS as seconds; hours beyond 24 are the next day's."""
    p = F.split(clock, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def write_monthly(df: DataFrame, ts: str, path: str) -> None:
    """Parquet by year and month; rows meet by day first, so a month has some thirty files and isn't one task's work."""
    dated = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    dated.repartition("year", "month", F.dayofmonth(ts)).sortWithinPartitions("year", "month", ts).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_feature_sets(sets: dict[str, DataFrame], folder: str) -> None:
    for name, df in sets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def landed_columns(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """(file_name, missing, n_rows) for each landed CSV file, from its first line and the number of its lines.

    A file's first block begins with its first line, and a task reads a block
    in order, so the header is the line with the least running number there.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")
    )
    first = F.min_by("value", F.when(F.col("at") == 0, F.col("id"))).alias("head")
    by_file = lines.groupBy("file_name").agg(first, F.count("*").alias("n_lines"))
    missing = F.array_except(F.array(*map(F.lit, expected)), F.split(F.regexp_replace("head", '"', ""), ","))
    return by_file.select("file_name", F.array_join(missing, ",").alias("missing"), (F.col("n_lines") - 1).alias("n_rows"))


def read_geometries(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """(id, kind, coordinates) of lines of JSON with a geometry; coordinates stay JSON text, as their nesting depends on the kind."""
    raw = spark.read.schema(f"{id_col} BIGINT, geometry STRUCT<type: STRING, coordinates: STRING>").json(path)
    return raw.select(id_col, F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"))
