"""Queries of profiles, distributions and quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.operators import profile as pr

from .registry import query, table
from .series import PANEL, panel


@query("a1_value_counts", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def a1(spark, sf):
    return pr.value_counts(table(spark, sf, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("a2_calendar_means", "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def a2(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "a3_pivot",
    "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1",
)
def a3(spark, sf):
    return table(spark, sf, "events").groupBy(F.hour("ts").alias("hour")).pivot("event_type", TYPES).count().na.fill(0)


@query(
    "a4_crosstab",
    "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1",
)
def a4(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return wide.withColumnsRenamed({"F": "f", "O": "o"})


@query(
    "a5_confusion_shares",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2",
)
def a5(spark, sf):
    return pr.shares_within(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus").withColumn("share", F.round("share", 6))


@query(
    "a6_conditional_shares",
    f"WITH {PANEL} SELECT user_id, round(avg(CASE WHEN state = 2 THEN 1.0 ELSE 0 END), 6) AS share_2, round(avg(CASE WHEN state = 3 THEN 1.0 ELSE 0 END), 6) AS share_3, count(*) AS n FROM panel GROUP BY 1",
)
def a6(spark, sf):
    def share(k):
        return F.round(F.count_if(F.col("state") == k) / F.count("*"), 6)

    return panel(spark, sf).groupBy("user_id").agg(share(2).alias("share_2"), share(3).alias("share_3"), F.count("*").alias("n"))


@query(
    "a7_group_distribution",
    f"WITH {PANEL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INTEGER) AS hour, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(CAST(ts AS DATE) AS VARCHAR), CAST(hour(ts) AS INTEGER)), 6) AS share FROM panel GROUP BY 1, 2, 3",
)
def a7(spark, sf):
    p = panel(spark, sf).withColumns({"day": F.to_date("ts").cast("string"), "hour": F.hour("ts")})
    return pr.shares_within(p, ["day", "hour"], "state").withColumn("share", F.round("share", 6))


@query(
    "a8_weekend_share",
    f"WITH {PANEL} SELECT CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, round(avg(CASE WHEN state = 3 THEN 1.0 ELSE 0 END), 6) AS share FROM panel GROUP BY 1",
)
def a8(spark, sf):
    weekend = (F.weekday("ts") >= 5).cast("int").alias("is_weekend")
    return panel(spark, sf).groupBy(weekend).agg(F.round(F.avg((F.col("state") == 3).cast("double")), 6).alias("share"))


@query("a9_distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def a9(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a10_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, round(100.0 * count(*) FILTER ({c} <> 0) / count(*), 4) AS nonzero_pct FROM lineitem"
        for c in NUMBERS
    ),
)
def a10(spark, sf):
    s = pr.summary(table(spark, sf, "lineitem"), NUMBERS)
    return s.withColumns({c: F.round(c, 4) for c in ("mean", "std", "nonzero_pct")})


@query(
    "a11_describe",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events GROUP BY 1""",
)
def a11(spark, sf):
    e = table(spark, sf, "events")
    stats = e.groupBy("event_type").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std")
    )
    boxes = pr.exact_quantiles(e, "value", pr.FIVE, ["event_type"]).withColumnRenamed("event_type", "__type")
    q = F.col("quantiles")
    return stats.join(boxes, F.col("event_type").eqNullSafe(F.col("__type")), "left").select(
        "event_type", "n", "mean", "std", q[0].alias("min"), *[F.round(q[i], 6).alias(f"q{i}") for i in (1, 2, 3)], q[4].alias("max")
    )


@query("a12_segment_stats", "SELECT user_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY 1")
def a12(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.count("*").alias("n")
    )


@query(
    "a13_median_mode",
    """WITH m AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY 1, 2)
       SELECT part.p_brand, median(part.p_size) AS median, min(m.p_size) AS mode FROM part JOIN m ON part.p_brand = m.p_brand AND k = 1 GROUP BY 1""",
)
def a13(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    modes = sizes.groupBy("p_brand").agg(F.min_by("p_size", F.struct(-F.col("n"), "p_size")).alias("mode"))
    medians = pr.exact_quantiles(table(spark, sf, "part"), "p_size", [0.5], ["p_brand"])
    return medians.join(modes, "p_brand").select("p_brand", F.col("quantiles")[0].alias("median"), "mode")


@query(
    "a14_above_quantile",
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.75) AS t FROM lineitem) SELECT round(t, 6) AS threshold, count(*) FILTER (l_extendedprice > t) AS n_above FROM lineitem, q GROUP BY t",
)
def a14(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_extendedprice")
    return pr.above_quantile(lines, "l_extendedprice", 0.75).withColumn("threshold", F.round("threshold", 6))


@query(
    "a15_correlation",
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem",
)
def a15(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("quantity_price"), F.round(F.corr("l_discount", "l_tax"), 6).alias("discount_tax")
    )


@query(
    "a16_coverage_span",
    "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6, 4) AS hours FROM events GROUP BY 1",
)
def a16(spark, sf):
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(span / 3600e6, 4).alias("hours"))


@query(
    "a17_null_profile",
    """WITH p AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS brand FROM part)
       SELECT 'size' AS feature, count(*) FILTER (size IS NULL) AS nulls, round(100.0 * count(*) FILTER (size IS NULL) / count(*), 6) AS pct FROM p
       UNION ALL SELECT 'brand', count(*) FILTER (brand IS NULL), round(100.0 * count(*) FILTER (brand IS NULL) / count(*), 6) FROM p""",
)
def a17(spark, sf):
    p = holes(spark, sf)
    return pr.null_profile(p, p.columns).withColumn("pct", F.round("pct", 6))


def holes(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("size"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("brand"),
        "p_type",
    )


@query(
    "a18_completeness",
    "SELECT round(100.0 * (1 - (count(*) FILTER (p_partkey % 4 = 0) + count(*) FILTER (p_partkey % 10 = 0)) / (3.0 * count(*))), 4) AS completeness_pct FROM part",
)
def a18(spark, sf):
    p = holes(spark, sf)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in p.columns), F.lit(0))
    return p.agg(F.round(100.0 * (1 - nulls / (F.lit(3.0) * F.count("*"))), 4).alias("completeness_pct"))


@query(
    "a19_null_drilldown",
    """WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
       top AS (SELECT user_id FROM e WHERE v IS NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)
       SELECT user_id, day, count(*) AS n FROM e WHERE v IS NULL AND user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""",
)
def a19(spark, sf):
    bad = table(spark, sf, "events").where("event_id % 7 = 0").select("user_id", F.to_date("ts").cast("string").alias("day"))
    top = bad.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1)
    return bad.join(F.broadcast(top.select("user_id")), "user_id", "left_semi").groupBy("user_id", "day").agg(F.count("*").alias("n"))


@query(
    "a20_duplicate_keys",
    "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT max(n) <= 1 AS is_unique, count(*) FILTER (n > 1) AS n_values, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS n_rows FROM c",
)
def a20(spark, sf):
    return pr.duplicate_keys(table(spark, sf, "orders"), "o_custkey")


@query(
    "a21_varying_columns",
    """SELECT 'c_mktsegment' AS feature, max(d) > 1 AS varies FROM (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS d FROM customer GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'same', false""",
)
def a21(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_nationkey") * 2).alias("same"))
    return pr.varying_in_duplicates(c, "c_nationkey", ["c_mktsegment", "same"])


@query(
    "a22_shared_attributes",
    "SELECT p_name, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
)
def a22(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n_brands")).where("n_brands > 1")


@query("a23_expected_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) < 66")
def a23(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n < 66")


@query(
    "a24_ordered_lines",
    """SELECT l_orderkey, count(*) AS n_points, round(sum(d), 4) AS length FROM (
         SELECT l_orderkey, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax, l_returnflag)) AS d FROM lineitem) GROUP BY 1 HAVING count(*) >= 2""",
)
def a24(spark, sf):
    from curbflow.operators.spatial import line_length

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    flat = lines.withColumns({"zero": F.lit(0.0)})
    # order, then the point's columns, decide ties
    rows = flat.select("l_orderkey", F.struct("l_linenumber", "l_quantity", "l_tax").alias("order"), F.col("l_quantity").alias("x"), F.col("zero").alias("y"), "l_returnflag")
    made = pr.ordered_lines(rows, "l_orderkey", "order", "x", "y", "l_returnflag")
    return made.select("l_orderkey", F.size("line").cast("long").alias("n_points"), F.round(line_length(F.col("line")), 4).alias("length"))


@query("a26_daily_presence", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def a26(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.count("*").alias("n"))


@query("a27_error_histogram", "SELECT CAST(l_linenumber - l_quantity % 7 AS BIGINT) AS error, count(*) AS n FROM lineitem GROUP BY 1")
def a27(spark, sf):
    error = (F.col("l_linenumber") - F.col("l_quantity") % 7).cast("long").alias("error")
    return table(spark, sf, "lineitem").groupBy(error).agg(F.count("*").alias("n"))


@query(
    "a28_conditional_means",
    "SELECT round(avg(CASE WHEN l_quantity > 25 THEN l_extendedprice END), 4) AS large_mean, round(avg(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 4) AS discounted_mean FROM lineitem",
)
def a28(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").agg(
        F.round(F.avg(F.when(F.col("l_quantity") > 25, price)), 4).alias("large_mean"),
        F.round(F.avg(F.when(F.col("l_discount") > 0.05, price)), 4).alias("discounted_mean"),
    )


@query(
    "a29_consistency",
    "SELECT count(*) AS n, count(*) FILTER (abs(n_chars - length(text)) > 0) AS n_off FROM documents",
)
def a29(spark, sf):
    off = F.abs(F.col("n_chars") - F.length("text")) > 0
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"))


@query(
    "a30_rule_violations",
    """SELECT 'non_positive_balance' AS rule, count(*) FILTER (c_acctbal <= 0) AS n FROM customer UNION ALL SELECT 'short_segment', count(*) FILTER (length(c_mktsegment) < 9) FROM customer
       UNION ALL SELECT 'key_zero', count(*) FILTER (c_custkey = 0) FROM customer""",
)
def a30(spark, sf):
    rules = {"non_positive_balance": F.col("c_acctbal") <= 0, "short_segment": F.length("c_mktsegment") < 9, "key_zero": F.col("c_custkey") == 0}
    return pr.violations(table(spark, sf, "customer"), rules)


@query(
    "a31_histogram",
    """WITH c AS (SELECT quantile_cont(l_extendedprice, 0.99) AS top, min(l_extendedprice) AS low FROM lineitem)
       SELECT CAST(least(floor((l_extendedprice - low) / ((top - low) / 50)) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM lineitem, c WHERE l_extendedprice <= top GROUP BY 1""",
)
def a31(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_extendedprice")
    bounds = pr.exact_quantiles(lines, "l_extendedprice", [0.0, 0.99]).select(F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("top"))
    return pr.histogram(lines.crossJoin(F.broadcast(bounds)), "l_extendedprice", F.col("low"), F.col("top"), 50)


@query(
    "a32_box_plots",
    "SELECT l_returnflag, min(l_quantity) AS q0, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS q4 FROM lineitem GROUP BY 1",
)
def a32(spark, sf):
    boxes = pr.exact_quantiles(table(spark, sf, "lineitem"), "l_quantity", pr.FIVE, ["l_returnflag"])
    return boxes.select("l_returnflag", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(5)])


@query("a33_bucket_counts", "SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a33(spark, sf):
    return table(spark, sf, "events").groupBy(F.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query(
    "a34_id_presence",
    "SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS n_have, (SELECT count(DISTINCT doc_id) FROM documents) AS n_want, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_found, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing",
)
def a34(spark, sf):
    from curbflow.operators.joins import coverage

    return coverage(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id")


@query(
    "dq_report",
    """SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM events
       UNION ALL SELECT 'null_values', CAST(count(*) FILTER (value IS NULL) AS DOUBLE) FROM events UNION ALL SELECT 'days', CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) FROM events""",
)
def dq(spark, sf):
    row = table(spark, sf, "events").agg(
        F.count("*").cast("double").alias("rows"),
        F.count_distinct("user_id").cast("double").alias("users"),
        F.count_if(F.col("value").isNull()).cast("double").alias("null_values"),
        F.count_distinct(F.to_date("ts")).cast("double").alias("days"),
    )
    return row.unpivot([], row.columns, "metric", "value")


