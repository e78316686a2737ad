"""Queries of joins: equi, as-of, interval, calendar, anti and semi joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from curbflow.functions import calendars
from curbflow.operators import joins

from .registry import query, table

#: Events of a made-up calendar; the third's end at midnight stands for the whole day.
INTERVALS = [
    (datetime(2024, 1, 3, 10), datetime(2024, 1, 3, 18)),
    (datetime(2024, 1, 3, 16), datetime(2024, 1, 4, 2)),
    (datetime(2024, 1, 10), datetime(2024, 1, 12)),
    (datetime(2024, 1, 20, 22), datetime(2024, 1, 21, 2)),
]
IN_INTERVALS = """(ts BETWEEN TIMESTAMP '2024-01-03 10:00:00' AND TIMESTAMP '2024-01-04 02:00:00'
  OR ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:59:59' OR ts BETWEEN TIMESTAMP '2024-01-20 22:00:00' AND TIMESTAMP '2024-01-21 02:00:00')"""


@query("j1_lookup_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query(
    "j2_composite_join",
    """SELECT a.event_id, count(b.event_id) AS n_same_hour FROM events a LEFT JOIN (SELECT event_id, user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error') b
       ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = b.h GROUP BY 1""",
)
def j2(spark, sf):
    e = table(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts"))
    errors = e.where("event_type = 'error'").groupBy("user_id", "h").agg(F.count("*").alias("n"))
    return e.join(errors, ["user_id", "h"], "left").select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_same_hour"))


@query("j3_many_to_one", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j3(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.many_to_one(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name")


@query(
    "j4_flags_lookup",
    """SELECT s_suppkey, r_name, CASE WHEN n_regionkey <> 0 THEN CASE WHEN n_regionkey % 2 = 1 THEN 'odd' ELSE 'even' END END AS odd_region FROM supplier
       LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def j4(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    flags = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "r_name", F.when(F.col("n_regionkey") != 0, F.when(F.col("n_regionkey") % 2 == 1, "odd").otherwise("even")).alias("odd_region")
    )
    return table(spark, sf, "supplier").join(flags, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "r_name", "odd_region")


DAILY = "daily AS (SELECT l_shipdate AS day_ts, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY 1)"


def daily(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate", "l_quantity")
    return lines.groupBy(F.col("l_shipdate").alias("day_ts")).agg(F.round(F.avg("l_quantity"), 6).alias("mean_qty"))


BEST = """, t AS (SELECT DISTINCT o_orderdate FROM orders),
 n AS (SELECT t.o_orderdate, d.day_ts, d.mean_qty, row_number() OVER (PARTITION BY t.o_orderdate ORDER BY abs(epoch(t.o_orderdate) - epoch(d.day_ts)), d.day_ts) AS k
       FROM t JOIN daily d ON {on})
 SELECT o.o_orderkey, n.day_ts, n.mean_qty FROM orders o LEFT JOIN n ON o.o_orderdate = n.o_orderdate AND n.k = 1"""


@query("j5_asof_nearest_tolerance", f"WITH {DAILY}" + BEST.format(on="abs(epoch(t.o_orderdate) - epoch(d.day_ts)) <= 172800"))
def j5(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return joins.asof_nearest(o, daily(spark, sf), "o_orderdate", "day_ts", 172800).select("o_orderkey", "day_ts", "mean_qty")


@query("j6_asof_nearest_unbounded", f"WITH {DAILY}" + BEST.format(on="true"))
def j6(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return joins.asof_nearest_unbounded(o, daily(spark, sf), "o_orderdate", "day_ts").select("o_orderkey", "day_ts", "mean_qty")


@query("j8_event_ongoing", f"SELECT event_id, CAST({IN_INTERVALS} AS INTEGER) AS is_event_ongoing FROM events")
def j8(spark, sf):
    raw = spark.createDataFrame(INTERVALS, "start timestamp_ntz, end timestamp_ntz")
    intervals = raw.withColumn("end", calendars.whole_day_end(F.col("end")))
    flagged = calendars.with_interval_flag(table(spark, sf, "events"), "ts", intervals, "is_event_ongoing")
    return flagged.select("event_id", "is_event_ongoing")


@query(
    "j9_school_holiday",
    """WITH e AS (SELECT event_id, CAST(ts - INTERVAL 400 DAY AS DATE) AS day FROM events)
       SELECT event_id, CAST(day BETWEEN DATE '2022-12-22' AND DATE '2023-01-08' AS INTEGER) AS is_school_holiday FROM e""",
)
def j9(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_sub(F.to_date("ts"), 400).alias("day"))
    dates = calendars.dates_of_ranges(calendars.school_holidays(spark))
    return calendars.with_date_flag(e, F.col("day"), dates, "is_school_holiday").select("event_id", "is_school_holiday")


@query(
    "j10_public_holiday",
    """SELECT o_orderkey, CAST(strftime(o_orderdate, '%m-%d') IN ('01-01', '01-06', '05-01', '08-15', '10-12', '11-01', '12-06', '12-08', '12-25', '06-24', '09-11', '12-26')
       OR CAST(o_orderdate AS DATE) IN (DATE '1995-04-14', DATE '1995-04-17', DATE '1996-04-05', DATE '1996-04-08', DATE '1997-03-28', DATE '1997-03-31', DATE '1998-04-10', DATE '1998-04-13',
       DATE '1999-04-02', DATE '1999-04-05', DATE '2000-04-21', DATE '2000-04-24', DATE '2001-04-13', DATE '2001-04-16') AS INTEGER) AS is_public_holiday FROM orders""",
)
def j10(spark, sf):
    holidays = calendars.public_holidays(spark, range(1995, 2002), "CT")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return calendars.with_date_flag(o, F.col("o_orderdate"), holidays, "is_public_holiday").select("o_orderkey", "is_public_holiday")


@query(
    "sc13_event_day",
    "SELECT event_id, CAST(CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-10', DATE '2024-01-20') AS INTEGER) AS is_event_day FROM events",
)
def sc13(spark, sf):
    starts = spark.createDataFrame(INTERVALS, "start timestamp_ntz, end timestamp_ntz").select(F.to_date("start").alias("day"))
    return calendars.with_date_flag(table(spark, sf, "events"), F.col("ts"), starts, "is_event_day").select("event_id", "is_event_day")


@query(
    "j14_anti_coverage",
    """SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS n_have, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_want,
       (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS n_found,
       (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_missing""",
)
def j14(spark, sf):
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return joins.coverage(have, table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")


@query(
    "j14_anti_ids",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def j14_ids(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(
    "j15_semi_chain",
    """SELECT c_nationkey, count(DISTINCT p_brand) AS n_brands FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1""",
)
def j15(spark, sf):
    nations = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, sf, "customer").join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = c.join(o, "c_custkey").join(lines, "o_orderkey").join(p, "p_partkey")
    return joined.groupBy("c_nationkey").agg(F.count_distinct("p_brand").alias("n_brands"))


@query(
    "j16_top_ids_semi",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 10)""",
)
def j16(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    top = o.groupBy("o_custkey").count().orderBy(F.desc("count"), "o_custkey").limit(10)
    return o.join(F.broadcast(top.select("o_custkey")), "o_custkey", "left_semi")


@query(
    "j17_feature_sets",
    """WITH a AS (SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1),
       b AS (SELECT user_id, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY 1),
       c AS (SELECT user_id, CAST(hour(max(ts)) AS INTEGER) AS last_hour FROM events GROUP BY 1)
       SELECT a.user_id, n, mean_value, n_errors, last_hour FROM a LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""",
)
def j17(spark, sf):
    e = table(spark, sf, "events")
    # the sets have one grain, so they are one aggregation rather than a chain of joins
    errors = F.count_if(F.col("event_type") == "error")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.when(errors > 0, errors).alias("n_errors"),
        F.hour(F.max("ts")).alias("last_hour"),
    )
