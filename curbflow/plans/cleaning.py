"""Queries of cleaning, calendar and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.functions import temporal
from curbflow.operators import clean

from .registry import query, table

STATES = {0: "No Data", 1: "Very Fluid", 2: "Fluid", 3: "Dense", 4: "Very Dense", 5: "Congested", 6: "Blocked"}


@query(
    "pf1_compact_timestamp",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS parsed FROM orders""",
)
def pf1(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "2024-bad").otherwise(F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    return o.select("o_orderkey", temporal.compact_timestamp(text).alias("parsed"))


@query(
    "pf2_day_first_timestamp",
    """SELECT event_id, date_trunc('second', ts) AS parsed FROM events""",
)
def pf2(spark, sf):
    text = F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    return table(spark, sf, "events").select("event_id", temporal.day_first_timestamp(text).alias("parsed"))


@query("pf3_epoch_millis", "SELECT event_id, date_trunc('millisecond', ts) AS parsed FROM events")
def pf3(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", temporal.epoch_millis_timestamp(millis).alias("parsed"))


@query(
    "pf4_date_range",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30 23:59:59'""",
)
def pf4(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return clean.between_dates(o, "o_orderdate", "1997-01-01", "1997-06-30")


@query("pf5_cutoff", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 23:59:59'")
def pf5(spark, sf):
    return clean.up_to(table(spark, sf, "events"), "ts", "2024-01-15 23:59:59").select("event_id")


@query(
    "pf6_numeric_coercion",
    """SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN p_brand ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE) AS n FROM part""",
)
def pf6(spark, sf):
    mixed = F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, sf, "part").select("p_partkey", clean.coerced(mixed).alias("n"))


@query("pf7_decimal_comma", "SELECT c_custkey, c_acctbal AS n FROM customer")
def pf7(spark, sf):
    text = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "customer").select("c_custkey", clean.decimal_comma(text).alias("n"))


@query(
    "pf8_drop_null",
    "SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL",
)
def pf8(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))
    return e.na.drop(subset=["value"])


@query("pf9_full_row_dedupe", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def pf9(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(
    "pf10_keep_last",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def pf10(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    last = clean.keep_one(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "event_type", "event_id")


@query(
    "pf11_typed_fill",
    """SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'Unknown') AS segment, coalesce(c.c_acctbal, 0.0) AS balance
       FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o.o_custkey = c.c_custkey""",
)
def pf11(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.na.fill({"segment": "Unknown", "balance": 0.0}).select("o_orderkey", "segment", "balance")


@query(
    "pf12_median_fill",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS size FROM part)
       SELECT p_partkey, CAST(coalesce(size, trunc((SELECT median(size) FROM p))) AS INTEGER) AS size FROM p""",
)
def pf12(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("size"))
    return clean.fill_median(p, "size")


@query(
    "pf13_code_labels",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 0 THEN 'No Data' WHEN 1 THEN 'Very Fluid' WHEN 2 THEN 'Fluid' WHEN 3 THEN 'Dense'
       WHEN 4 THEN 'Very Dense' WHEN 5 THEN 'Congested' WHEN 6 THEN 'Blocked' ELSE 'Unknown (' || l_linenumber || ')' END AS label FROM lineitem""",
)
def pf13(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clean.labelled(F.col("l_linenumber"), STATES).alias("label"))


@query(
    "pf14_char_codes",
    """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -99 END AS INTEGER) AS code FROM orders""",
)
def pf14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.coded(F.col("o_orderstatus"), {"O": 0, "F": 1}, -99).alias("code"))


@query("pf15_length_filter", "SELECT o_orderkey FROM orders WHERE length(o_orderpriority) = 8")
def pf15(spark, sf):
    return table(spark, sf, "orders").where(F.length("o_orderpriority") == 8).select("o_orderkey")


@query(
    "pf16_domain_check",
    """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT coalesce(l_linenumber IN (1, 2, 3, 4, 5), false) GROUP BY 1""",
)
def pf16(spark, sf):
    bad = table(spark, sf, "lineitem").where(clean.outside(F.col("l_linenumber"), [1, 2, 3, 4, 5]))
    return bad.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("pf17_constant_columns", "SELECT event_id, value FROM events")
def pf17(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.lit(1).alias("one"), F.lit("x").alias("same"))
    return e.select(*clean.varying_columns(e, e.columns))


@query(
    "pf19_rename_on_clash",
    """SELECT o.o_orderkey, o.o_custkey AS id, c.c_nationkey AS id_customer FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def pf19(spark, sf):
    o = table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "id"}).select("o_orderkey", "id")
    c = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "key", "c_nationkey": "id_customer"})
    return o.join(c.select("key", "id_customer"), F.col("id") == F.col("key")).drop("key")


@query(
    "pf21_stitch_records",
    """WITH r AS (SELECT event_type AS file, event_id, CASE WHEN event_id % 3 <> 1 THEN CAST(ts AS VARCHAR) IS NOT NULL END AS head,
                  CASE WHEN event_id % 3 <> 0 THEN value END AS body FROM events),
       n AS (SELECT *, lead(head) OVER w AS nh, lead(body) OVER w AS nb FROM r WINDOW w AS (PARTITION BY file ORDER BY event_id))
       SELECT file, event_id, coalesce(body, nb) AS body FROM n
       WHERE head IS NOT NULL AND (body IS NOT NULL OR (nh IS NULL AND nb IS NOT NULL))""",
)
def pf21(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("file"),
        "event_id",
        F.when(F.col("event_id") % 3 != 1, F.col("ts")).alias("head"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("body"),
    )
    return clean.stitched(e, "event_id", "head", "body").select("file", "event_id", "body")


@query(
    "pf22_unique_key",
    "SELECT 'o_orderkey' AS key_column",
)
def pf22(spark, sf):
    key = clean.unique_key(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderkey"])
    return spark.createDataFrame([(key,)], "key_column string")


@query("pf23_row_key", "SELECT count(*) AS n, count(*) AS n_keys FROM orders")
def pf23(spark, sf):
    keyed = clean.with_row_key(table(spark, sf, "orders"), ["o_orderkey"])
    return keyed.agg(F.count("*").alias("n"), F.count_distinct("row_key").alias("n_keys"))


PARTS = """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(day(ts) AS INTEGER) AS day, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(week(ts) AS INTEGER) AS iso_week,
  CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year FROM events"""


@query("sc1_calendar_parts", PARTS)
def sc1(spark, sf):
    parts = temporal.calendar_parts(F.col("ts"))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("sc2_calendar_names", "SELECT o_orderkey, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name FROM orders")
def sc2(spark, sf):
    names = temporal.calendar_names(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in names.items()])


@query(
    "sc3_weekend_flags",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend, CAST(isodow(o_orderdate) < 6 AS INTEGER) AS is_weekday FROM orders""",
)
def sc3(spark, sf):
    flags = temporal.weekend_flags(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in flags.items()])


@query(
    "sc4_cyclical",
    """SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos,
       round(sin((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0.0 AS dow_sin, round(cos((isodow(ts) - 1) * 2 * pi() / 7), 6) + 0.0 AS dow_cos,
       round(sin((month(ts) - 1) * 2 * pi() / 12), 6) + 0.0 AS month_sin, round(cos((month(ts) - 1) * 2 * pi() / 12), 6) + 0.0 AS month_cos FROM events""",
)
def sc4(spark, sf):
    waves = temporal.cyclical(F.col("ts"), month_zero_based=True)
    return table(spark, sf, "events").select("event_id", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in waves.items()])


@query(
    "sc5_7_day_segments",
    """SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS segment,
       CASE WHEN hour(ts) <= 6 THEN 'Night' WHEN hour(ts) <= 12 THEN 'Morning' WHEN hour(ts) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS segment_right,
       CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 10 THEN 'Morning Rush' WHEN hour(ts) < 16 THEN 'Daytime' WHEN hour(ts) < 20 THEN 'Evening Rush' ELSE 'Evening' END AS rush
       FROM events""",
)
def sc5(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        temporal.day_segment(ts).alias("segment"),
        temporal.day_segment_right(ts).alias("segment_right"),
        temporal.rush_hour_segment(ts).alias("rush"),
    )


@query(
    "sc8_9_season_month",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring'
       WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders""",
)
def sc8(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", temporal.season(d).alias("season"), temporal.year_month(d).alias("year_month"))


@query(
    "sc10_local_to_utc",
    """SELECT event_id, ts - INTERVAL 1 HOUR AS utc FROM events""",
)
def sc10(spark, sf):
    return table(spark, sf, "events").select("event_id", temporal.local_to_utc(F.col("ts")).alias("utc"))


@query(
    "sc29_string_hygiene",
    """SELECT p_partkey, upper(trim(p_name)) AS name, length(p_name) AS len, contains(p_name, 'widget') AS widget,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS size_code, starts_with(p_brand, 'Brand#1') AS brand_1 FROM part""",
)
def sc29(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.upper(F.trim("p_name")).alias("name"),
        F.length("p_name").cast("long").alias("len"),
        F.contains("p_name", F.lit("widget")).alias("widget"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size_code"),
        F.startswith("p_brand", F.lit("Brand#1")).alias("brand_1"),
    )


@query("sc32_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sc32(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "sc33_forecast_error",
    "SELECT l_orderkey, l_linenumber, CAST(l_linenumber - l_quantity % 7 AS BIGINT) AS error FROM lineitem",
)
def sc33(spark, sf):
    error = (F.col("l_linenumber") - F.col("l_quantity") % 7).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", error.alias("error"))


@query(
    "so1_union_all",
    """SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, p_name, p_brand FROM part""",
)
def so1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return c.unionByName(p, allowMissingColumns=True)


@query("so2_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def so2(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.subtract(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


@query(
    "so3_intersect",
    "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50",
)
def so3(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase' and value > 50").select("user_id"))


@query("sl2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sl2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "sl3_peak_hour",
    """WITH c AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, h) AS k FROM c)
       SELECT event_type, CAST(h AS INTEGER) AS hour, n, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""",
)
def sl3(spark, sf):
    from pyspark.sql import Window

    counts = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "hour"))
    return counts.withColumn("rank", rank).where("rank <= 3")


@query("sl4_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 500")
def sl4(spark, sf):
    """A reproducible sample of 500 rows: the smallest hashes."""
    return table(spark, sf, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42"))), "o_orderkey").limit(500).select("o_orderkey")


@query("sl5_random_ids", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(CAST(user_id AS VARCHAR) || ':7'), user_id LIMIT 20")
def sl5(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.orderBy(F.md5(F.concat(F.col("user_id").cast("string"), F.lit(":7"))), "user_id").limit(20)


@query(
    "sl6_representatives",
    """WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
       SELECT (SELECT user_id FROM s ORDER BY m DESC, user_id LIMIT 1) AS highest, (SELECT user_id FROM s ORDER BY m, user_id LIMIT 1) AS lowest,
              (SELECT user_id FROM s ORDER BY sd DESC, user_id LIMIT 1) AS widest""",
)
def sl6(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return s.agg(
        F.max_by("user_id", F.struct("m", -F.col("user_id"))).alias("highest"),
        F.min_by("user_id", F.struct("m", "user_id")).alias("lowest"),
        F.max_by("user_id", F.struct("sd", -F.col("user_id"))).alias("widest"),
    )


@query("sl1_total_order", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS place FROM events")
def sl1(spark, sf):
    """The place of each row in a total order, from range partitions and their sizes."""
    from curbflow.operators.layout import with_row_index

    return with_row_index(table(spark, sf, "events"), ["ts", "event_id"], "place").select("event_id", "place")
