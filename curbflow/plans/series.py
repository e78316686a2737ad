"""Queries of the panel operators; a user's events are the panel, their type's code the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions import calendars, temporal
from curbflow.operators import clean
from curbflow.operators import timeseries as ts_

from .registry import query, table

CODES = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}
STATE = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE -1 END"
PANEL = f"panel AS (SELECT event_id, user_id, ts, value, CAST({STATE} AS INTEGER) AS state FROM events)"


def panel(spark, sf) -> DataFrame:
    state = clean.coded(F.col("event_type"), CODES, -1)
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", state.alias("state"))


GRID = f"""{PANEL}, spans AS (SELECT user_id, date_trunc('hour', min(ts)) AS low, date_trunc('hour', max(ts)) AS high FROM panel GROUP BY 1),
 labels AS (SELECT user_id, unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS t FROM spans),
 u AS (SELECT user_id, t, NULL AS state, 1 AS label FROM labels UNION ALL SELECT user_id, ts, state, 0 FROM panel),
 f AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, label, state ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM u),
 grid AS (SELECT user_id, t AS ts, v AS state FROM f WHERE label = 1)"""


def hourly(spark, sf) -> DataFrame:
    return ts_.resample_ffill(panel(spark, sf), "user_id", "ts", "state", 3600)


@query("ts1_resample_ffill", f"WITH {GRID} SELECT user_id, ts, state FROM grid")
def ts1(spark, sf):
    return hourly(spark, sf)


@query("ts1_resample_monthly", f"WITH {GRID} SELECT user_id, ts, state FROM grid")
def ts1_monthly(spark, sf):
    """The events all lie in one month, so restarting by month gives the same grid."""
    return ts_.resample_ffill(panel(spark, sf), "user_id", "ts", "state", 3600, reset_monthly=True)


@query(
    "ts1_monthly_reset",
    """WITH p AS (SELECT o_custkey AS k, o_orderdate AS t, o_orderkey % 7 AS v, date_trunc('month', o_orderdate) AS m FROM orders),
       s AS (SELECT k, m, date_trunc('day', min(t)) AS low, date_trunc('day', max(t)) AS high FROM p GROUP BY 1, 2),
       u AS (SELECT k, m, unnest(generate_series(low, high, INTERVAL 1 DAY)) AS t, NULL AS v, 1 AS label FROM s UNION ALL SELECT k, m, t, v, 0 FROM p),
       f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY k, m ORDER BY t, label, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM u)
       SELECT k AS o_custkey, t AS o_orderdate, state FROM f WHERE label = 1""",
)
def ts1_monthly_reset(spark, sf):
    """Customers' orders over years: each month's grid is its own, and no value crosses into the next month."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", (F.col("o_orderkey") % 7).alias("state"))
    return ts_.resample_ffill(o, "o_custkey", "o_orderdate", "state", 86400, reset_monthly=True)


@query(
    "ts2_row_lags",
    f"""WITH {PANEL} SELECT event_id, {", ".join(f"lag(state, {n}) OVER w AS lag_{n}" for n in (1, 6, 12, 24))} FROM panel
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def ts2(spark, sf):
    lagged = ts_.row_lags(panel(spark, sf), "user_id", "ts", "state", {f"lag_{n}": n for n in (1, 6, 12, 24)})
    return lagged.select("event_id", "lag_1", "lag_6", "lag_12", "lag_24")


@query(
    "ts3_exact_lag",
    f"""WITH {GRID} SELECT user_id, ts, lag(state, 24) OVER (PARTITION BY user_id ORDER BY ts) AS lag_24h FROM grid""",  # the grid has every hour
)
def ts3(spark, sf):
    return ts_.exact_lag(hourly(spark, sf), "user_id", "ts", "state", 86400, "lag_24h").select("user_id", "ts", "lag_24h")


@query(
    "ts4_fill_both_ways",
    """WITH p AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 AND user_id % 10 <> 0 THEN value END AS v FROM events),
       f AS (SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM p)
       SELECT event_id, v FROM f WHERE v IS NOT NULL""",
)
def ts4(spark, sf):
    v = F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 10 != 0), F.col("value"))
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", v.alias("v"))
    return ts_.fill_both_ways(e, "user_id", "ts", "v").select("event_id", "v")


@query(
    "ts5_weather_fill",
    """WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END) AS v FROM orders GROUP BY 1)
       SELECT day, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            first_value(v IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM d""",
)
def ts5(spark, sf):
    """A daily table, one row for each day of the calendar, filled in time order in one window."""
    o = table(spark, sf, "orders")
    d = o.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.max(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice"))).alias("v"))
    return ts_.fill_both_ways(d.withColumn("all", F.lit(0)), "all", "day", "v").select("day", "v")


@query(
    "ts6_inter_arrival",
    "SELECT event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts), 3) AS gap_s FROM events",
)
def ts6(spark, sf):
    return ts_.with_gap(table(spark, sf, "events"), "user_id", "ts").select("event_id", F.round("gap_s", 3).alias("gap_s"))


@query(
    "ts7_irregular",
    """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
       SELECT user_id, count(*) AS n FROM g WHERE gap IS NOT NULL AND gap <> 300 GROUP BY 1""",
)
def ts7(spark, sf):
    gaps = ts_.with_gap(table(spark, sf, "events"), "user_id", "ts")
    return gaps.where("gap_s is not null and gap_s <> 300").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "ts8_gap_report",
    """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
       SELECT user_id, count(*) FILTER (gap > 3600) AS n_gaps, round(max(gap), 3) AS largest_gap_s FROM g GROUP BY 1""",
)
def ts8(spark, sf):
    report = ts_.gap_report(table(spark, sf, "events"), "user_id", "ts", 3600)
    return report.select("user_id", "n_gaps", F.round("largest_gap_s", 3).alias("largest_gap_s"))


@query(
    "ts9_missing_dates",
    """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d)
       WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
)
def ts9(spark, sf):
    return ts_.missing_dates(table(spark, sf, "orders"), "o_orderdate", "1995-01-01", "2001-12-31").select(F.col("day").cast("string"))


@query(
    "ts10_coverage",
    """SELECT round(100.0 * count(DISTINCT CAST(o_orderdate AS DATE)) / 2557, 4) AS coverage_pct FROM orders""",
)
def ts10(spark, sf):
    missing = ts_.missing_dates(table(spark, sf, "orders"), "o_orderdate", "1995-01-01", "2001-12-31")
    return missing.agg(F.round(100.0 * (2557 - F.count("*")) / 2557, 4).alias("coverage_pct"))


@query(
    "ts11_neighbours",
    f"WITH {PANEL} SELECT event_id, lag(state) OVER w AS prev_state, lead(state) OVER w AS next_state FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def ts11(spark, sf):
    return ts_.with_neighbours(panel(spark, sf), "user_id", ["ts", "event_id"], "state").select("event_id", "prev_state", "next_state")


@query(
    "ts12_consecutive",
    f"""WITH {PANEL}, n AS (SELECT state, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM panel)
        SELECT state, count(*) FILTER (p = state) AS n_same, round(100.0 * count(*) FILTER (p = state) / count(*), 6) AS pct FROM n GROUP BY 1""",
)
def ts12(spark, sf):
    near = ts_.with_neighbours(panel(spark, sf), "user_id", ["ts", "event_id"], "state")
    same = F.count_if(F.col("prev_state") == F.col("state"))
    return near.groupBy("state").agg(same.alias("n_same"), F.round(100.0 * same / F.count("*"), 6).alias("pct"))


@query(
    "ts13_run_lengths",
    f"""WITH {PANEL}, c AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS ch FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT user_id, state, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c),
        l AS (SELECT user_id, state, run, count(*) AS length FROM r GROUP BY 1, 2, 3),
        m AS (SELECT state, length, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, length) AS k FROM l GROUP BY 1, 2)
        SELECT l.state, count(*) AS n_runs, round(avg(l.length), 6) AS mean_length, max(l.length) AS max_length, min(m.length) AS mode_length
        FROM l JOIN m ON l.state = m.state AND m.k = 1 GROUP BY 1""",
)
def ts13(spark, sf):
    runs = ts_.runs(panel(spark, sf), "user_id", ["ts", "event_id"], "state")
    return runs.groupBy("state").agg(
        F.count("*").alias("n_runs"),
        F.round(F.avg("length"), 6).alias("mean_length"),
        F.max("length").alias("max_length"),
        F.mode("length", True).alias("mode_length"),
    )


STEPS = f"""{PANEL}, s AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, state AS to_state FROM panel),
 t AS (SELECT from_state, to_state, count(*) AS n FROM s WHERE from_state IS NOT NULL GROUP BY 1, 2),
 q AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM t)"""


def steps(spark, sf) -> DataFrame:
    return ts_.transitions(panel(spark, sf), "user_id", ["ts", "event_id"], "state")


@query("ts14_transitions", f"WITH {STEPS} SELECT from_state, to_state, n, round(p, 6) AS p FROM q")
def ts14(spark, sf):
    return steps(spark, sf).withColumn("p", F.round("p", 6))


@query("ts15_top_transitions", f"WITH {STEPS} SELECT from_state, to_state, n FROM q ORDER BY n DESC, from_state, to_state LIMIT 5")
def ts15(spark, sf):
    return steps(spark, sf).select("from_state", "to_state", "n").orderBy(F.desc("n"), "from_state", "to_state").limit(5)


@query(
    "ts16_persistence",
    f"""WITH {STEPS} SELECT from_state AS state, round(p, 6) AS persistence, round(1 - p, 6) AS change_rate, round(avg(p) OVER (), 6) AS mean_stability FROM q WHERE from_state = to_state""",
)
def ts16(spark, sf):
    from pyspark.sql import Window

    same = steps(spark, sf).where("from_state = to_state")  # one row for each state
    mean = F.avg("p").over(Window.partitionBy(F.lit(0)))
    return same.select(
        F.col("from_state").alias("state"),
        F.round("p", 6).alias("persistence"),
        F.round(1 - F.col("p"), 6).alias("change_rate"),
        F.round(mean, 6).alias("mean_stability"),
    )


@query(
    "ts17_slot_expansion",
    """SELECT o_orderkey, CAST(i AS INTEGER) AS slot, substr(o_orderpriority, CAST(i AS INTEGER) + 1, 1) AS symbol, o_orderdate + to_minutes(CAST(5 * i AS INTEGER)) AS slot_ts
       FROM orders, unnest(range(length(o_orderpriority))) t(i)""",
)
def ts17(spark, sf):
    slots = ts_.expand_slots(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority")
    return slots.select("o_orderkey", "slot", "symbol", "slot_ts")


@query(
    "ts17_slot_expansion_known",
    """SELECT o_orderkey, CAST(i AS INTEGER) AS slot, substr(o_orderpriority, CAST(i AS INTEGER) + 1, 1) AS symbol FROM orders, unnest(range(length(o_orderpriority))) t(i)
       WHERE substr(o_orderpriority, CAST(i AS INTEGER) + 1, 1) IN ('1', '2', '3')""",
)
def ts17_known(spark, sf):
    slots = ts_.expand_slots(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", drop_unknown=["1", "2", "3"])
    return slots.select("o_orderkey", "slot", "symbol")


@query(
    "ts18_expected_slots",
    """SELECT user_id, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS BIGINT) AS days_covered,
       CAST((date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1) * 288 AS BIGINT) AS expected_slots FROM events GROUP BY 1""",
)
def ts18(spark, sf):
    days = (F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))) + 1).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(days.alias("days_covered"), (days * 288).alias("expected_slots"))


@query(
    "ts19_top_segment_hours",
    f"""WITH {PANEL}, top AS (SELECT user_id FROM panel GROUP BY 1 ORDER BY avg(CASE WHEN state = 3 THEN 1.0 ELSE 0.0 END) DESC, user_id LIMIT 3)
        SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, round(avg(CASE WHEN state = 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM panel WHERE user_id IN (SELECT user_id FROM top) GROUP BY 1, 2""",
)
def ts19(spark, sf):
    p = panel(spark, sf)
    share = F.avg((F.col("state") == 3).cast("double"))
    top = p.groupBy("user_id").agg(share.alias("s")).orderBy(F.desc("s"), "user_id").limit(3).select("user_id")
    near = p.join(F.broadcast(top), "user_id", "left_semi")
    return near.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.round(share, 6).alias("share"))


@query(
    "pipeline_base_features",
    f"""WITH {GRID}, l AS (SELECT user_id, ts, state, lag(state, 1) OVER w AS lag_1, lag(state, 6) OVER w AS lag_6, lag(state, 24) OVER w AS lag_24 FROM grid WINDOW w AS (PARTITION BY user_id ORDER BY ts))
        SELECT user_id, ts, state, lag_1, lag_6, lag_24, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
          round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos,
          CAST(CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06') AS INTEGER) AS is_public_holiday, 0 AS is_school_holiday
        FROM l WHERE lag_1 IS NOT NULL AND lag_6 IS NOT NULL AND lag_24 IS NOT NULL""",
)
def base_features(spark, sf):
    """Resample, calendar, lags, holidays, drop rows without lags: one shuffle by segment."""
    lags = {f"lag_{n}": n for n in (1, 6, 24)}
    df = ts_.row_lags(hourly(spark, sf), "user_id", "ts", "state", lags).na.drop(subset=list(lags))
    ts = F.col("ts")
    waves = temporal.cyclical(ts)
    df = df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": temporal.day_of_week(ts),
            "is_weekend": temporal.weekend_flags(ts)["is_weekend"],
            "hour_sin": F.round(waves["hour_sin"], 6) + F.lit(0.0),
            "hour_cos": F.round(waves["hour_cos"], 6) + F.lit(0.0),
        }
    )
    holidays = calendars.public_holidays(spark, range(2022, 2026), "CT")
    df = calendars.with_date_flag(df, ts, holidays, "is_public_holiday")
    school = calendars.dates_of_ranges(calendars.school_holidays(spark))
    return calendars.with_date_flag(df, ts, school, "is_school_holiday")
