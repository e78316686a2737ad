"""Queries of tariffs, parking cost, schedules and static features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from curbflow.functions import pricing

from .registry import query, table

#: A made-up tariff table: id, code, fraction type, min and max time, rate, max cost.
TARIFFS = [
    (0, "A", 1, 0.0, 4.0, 2.5, 10.0),
    (1, "RES", 2, 1.0, 7.0, 0.2, 1.0),
    (2, "CYD", 0, 0.0, 30.0, 0.0, 0.0),
    (3, "EDM2", 0, 0.0, 30.0, 2.8, 2.8),
    (4, "BUFM", 2, 0.0, 24.0, 4.5, 36.0),
    (5, "GRA", 1, 0.5, 2.0, 3.0, 6.0),
    (6, "ZZ", 0, 0.0, 48.0, 1.0, 1.0),
]
TARIFF_VALUES = "tariffs(tariff_id, code, fraction_type, min_time, max_time, rate, max_cost) AS (VALUES " + ", ".join(
    f"({i}, '{c}', {f}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({r} AS DOUBLE), CAST({m} AS DOUBLE))" for i, c, f, a, b, r, m in TARIFFS
) + ")"


@query(
    "sc16_17_tariff_type",
    f"""WITH {TARIFF_VALUES} SELECT l_orderkey, l_linenumber, CASE code WHEN 'A' THEN 'Blue Zone A' WHEN 'RES' THEN 'Resident' WHEN 'CYD' THEN 'Loading/Unloading (DUM)'
        WHEN 'EDM2' THEN 'School/Special Zone' WHEN 'BUFM' THEN 'Bus Function/Event' WHEN 'GRA' THEN 'Green Zone' ELSE 'Unknown' END AS tariff_type,
        CASE code WHEN 'A' THEN 'hours' WHEN 'RES' THEN 'days' WHEN 'CYD' THEN 'minutes' WHEN 'EDM2' THEN 'minutes' WHEN 'BUFM' THEN 'event/hours' WHEN 'GRA' THEN 'hours' ELSE 'unknown' END AS unit
        FROM lineitem JOIN tariffs ON l_partkey % 7 = tariff_id""",
)
def sc16(spark, sf):
    t = pricing.tariffs_table(spark, TARIFFS)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("tariff_id"))
    kind = pricing.tariff_type(F.col("code"))
    unit = pricing.tariff_unit(F.col("code"), F.col("fraction_type"), F.col("max_time"))
    return lines.join(F.broadcast(t), "tariff_id").select("l_orderkey", "l_linenumber", kind.alias("tariff_type"), unit.alias("unit"))


@query(
    "sc18_parking_cost",
    f"""WITH {TARIFF_VALUES}, s AS (SELECT l_orderkey, l_linenumber, l_quantity * 30 - 60 AS minutes, tariffs.*,
          CASE code WHEN 'A' THEN 'hours' WHEN 'RES' THEN 'days' WHEN 'CYD' THEN 'minutes' WHEN 'EDM2' THEN 'minutes' WHEN 'BUFM' THEN 'event' WHEN 'GRA' THEN 'hours' END AS unit
        FROM lineitem JOIN tariffs ON l_partkey % 7 = tariff_id),
        u AS (SELECT *, CASE unit WHEN 'hours' THEN least(greatest(minutes / 60.0, min_time), max_time) WHEN 'days' THEN least(greatest(ceil(minutes / 1440.0), min_time), max_time)
          WHEN 'minutes' THEN least(greatest(minutes, min_time), max_time) WHEN 'event' THEN least(minutes / 60.0, max_time) END AS units FROM s)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN minutes < 0 THEN 0.0 WHEN units IS NULL THEN NULL
          ELSE round(CAST(greatest(least(CASE WHEN fraction_type IN (1, 2) THEN rate * units WHEN rate > 0 AND units > 0 THEN rate ELSE 0.0 END, max_cost), 0.0) AS DECIMAL(20, 6)), 2) END AS DECIMAL(10, 2)) AS cost FROM u""",
)
def sc18(spark, sf):
    t = pricing.tariffs_table(spark, TARIFFS)
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 7).alias("tariff_id"), (F.col("l_quantity") * 30 - 60).alias("minutes")
    )
    # the unit is the tariff's, so it is worked out once a tariff
    t = t.withColumn("unit", pricing.tariff_unit(F.col("code"), F.col("fraction_type"), F.col("max_time")))
    return pricing.with_parking_cost(lines.join(F.broadcast(t), "tariff_id"), "minutes", "unit").select("l_orderkey", "l_linenumber", "cost")


#: A made-up schedule table: id, description, whether it holds on holidays, whether parking is allowed only inside.
SCHEDULES = [
    (0, "de Dl a Dv de 08:00 a 14:00 i de 16:00 a 20:00, Ds de 09:00 a 14:00", 0, False),
    (1, "Dl a Dg de 00:00 a 24:00", 1, True),
    (2, "Diumenges i festius de 22:00 a 06:00", 0, True),
    (3, "consulteu el tauler", 0, False),
]


@query(
    "sc19_schedule_rules",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_size % 12 AS h FROM part)
       SELECT k AS schedule_id, 5 AS n_days, CAST(h * 3600 AS INTEGER) AS start_sec, CAST((h + 8) * 3600 AS INTEGER) AS end_sec, false AS applies_holidays FROM p WHERE kind = 0
       UNION ALL SELECT k, 5, CAST((h + 10) * 3600 AS INTEGER), 82800, false FROM p WHERE kind = 0
       UNION ALL SELECT k, 1, 32400, 50400, false FROM p WHERE kind = 0
       UNION ALL SELECT k, 7, 0, 86400, true FROM p WHERE kind = 1
       UNION ALL SELECT k, 1, 79200, CAST(h * 3600 AS INTEGER), true FROM p WHERE kind = 2""",
)
def sc19(spark, sf):
    """Schedule texts of the parts' sizes: two slots and a second day, a whole week, holidays, and one without rules."""
    kind, h = F.col("p_partkey") % 4, F.col("p_size") % 12

    def clock(hour):
        return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))

    two = F.concat(F.lit("de Dl a Dv de "), clock(h), F.lit(" a "), clock(h + 8), F.lit(" i de "), clock(h + 10), F.lit(" a 23:00, Ds de 09:00 a 14:00"))
    text = F.when(kind == 0, two).when(kind == 1, "Dl a Dg de 00:00 a 24:00").when(kind == 2, F.concat(F.lit("Diumenges i festius de 22:00 a "), clock(h)))
    texts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("schedule_id"), F.coalesce(text, F.lit("consulteu el tauler")).alias("description"), (kind == 1).cast("int").alias("includes_holidays")
    )
    rules = pricing.schedule_rules(texts)
    return rules.select("schedule_id", F.size("days").alias("n_days"), "start_sec", "end_sec", "applies_holidays")


@query(
    "sc19_rejected_parts",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS kind, lpad(CAST(p_size % 12 AS VARCHAR), 2, '0') || ':00' AS h FROM part)
       SELECT k AS schedule_id, 'rule' AS side, 'Dl a Dv de ' || h || ' a 20:00,' AS part, NULL AS reason FROM p WHERE kind = 0
       UNION ALL SELECT k, 'reject', 'Ds', 'no slot' FROM p WHERE kind = 0
       UNION ALL SELECT k, 'reject', 'matins ' || h || ' a 14:00,', 'no day' FROM p WHERE kind = 1
       UNION ALL SELECT k, 'rule', 'Dg de 09:00 a 14:00', NULL FROM p WHERE kind = 1
       UNION ALL SELECT k, 'rule', 'de ' || h || ' a 20:00', NULL FROM p WHERE kind = 2
       UNION ALL SELECT k, 'reject', 'consulteu el tauler', 'neither day nor slot' FROM p WHERE kind = 3""",
)
def sc19_rejects(spark, sf):
    """Each part of each text is either a rule's or a reject's; null texts have none."""
    kind, clock = F.col("p_partkey") % 5, F.concat(F.lpad((F.col("p_size") % 12).cast("string"), 2, "0"), F.lit(":00"))
    text = (
        F.when(kind == 0, F.concat(F.lit("de Dl a Dv de "), clock, F.lit(" a 20:00, i Ds")))
        .when(kind == 1, F.concat(F.lit("matins "), clock, F.lit(" a 14:00, Dg de 09:00 a 14:00")))
        .when(kind == 2, F.concat(F.lit("de "), clock, F.lit(" a 20:00")))
        .when(kind == 3, "consulteu el tauler")
    )
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("schedule_id"), text.alias("description"), F.lit(0).alias("includes_holidays"))
    rules = pricing.schedule_parts(texts).where("reason IS NULL").select("schedule_id", F.lit("rule").alias("side"), F.trim("part").alias("part"), "reason")
    return rules.unionByName(pricing.rejected_parts(texts).withColumn("side", F.lit("reject")))


def schedules(spark):
    return spark.createDataFrame(SCHEDULES, "schedule_id int, description string, includes_holidays int, only_inside boolean")


@query(
    "sc20_regulation_status",
    """WITH e AS (SELECT event_id, CAST(user_id % 5 AS INTEGER) AS s, isodow(ts) - 1 AS d, epoch(ts - date_trunc('day', ts)) AS sec, CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-06') AS h FROM events)
       SELECT event_id, CASE s WHEN 0 THEN CASE WHEN NOT h AND ((d < 5 AND (floor(sec) >= 28800 AND floor(sec) < 50400 OR floor(sec) >= 57600 AND floor(sec) < 72000)) OR (d = 5 AND floor(sec) >= 32400 AND floor(sec) < 50400)) THEN 'Regulated' ELSE 'Unregulated' END
         WHEN 1 THEN 'Regulated' WHEN 2 THEN CASE WHEN (h OR d = 6) AND (floor(sec) >= 79200 OR floor(sec) < 21600) THEN 'Regulated' ELSE 'Parking Prohibited' END ELSE 'Unknown Schedule' END AS status FROM e""",
)
def sc20(spark, sf):
    s = schedules(spark)
    holidays = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 6),)], "holiday date")
    checks = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 5).cast("int").alias("schedule"))
    return pricing.regulation_status(checks, "ts", "schedule", pricing.schedule_rules(s), s, holidays).select("event_id", "status")


@query(
    "sc21_22_tariff_text",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.50 EUR/hora' WHEN 1 THEN 'gratis' END AS t FROM part)
       SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0.0) AS rate, t IS NOT NULL AS has_tarifa,
         TRY_CAST(nullif(regexp_extract(t, '\\d+\\.?\\d*', 0), '') AS DOUBLE) AS tarifa_amount, CASE WHEN contains(lower(t), 'hora') THEN 'hour' WHEN t IS NOT NULL THEN 'day' END AS tarifa_period FROM p""",
)
def sc21(spark, sf):
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".50 EUR/hora"))).when(F.col("p_partkey") % 3 == 1, "gratis")
    features = pricing.tariff_text_features(F.col("t"))
    p = table(spark, sf, "part").select("p_partkey", t.alias("t"))
    return p.select("p_partkey", pricing.tariff_amount(F.col("t")).alias("rate"), *[c.alias(n) for n, c in features.items()])


HOURS = """CASE p_partkey % 4 WHEN 0 THEN 'L-V 08:00-20:00' WHEN 1 THEN '24h S' WHEN 2 THEN 'sense dades' END"""


@query(
    "sc23_schedule_hours",
    f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 0 ELSE 8 END AS start_hour, CASE p_partkey % 4 WHEN 1 THEN 24 ELSE 20 END AS end_hour,
        CASE p_partkey % 4 WHEN 1 THEN 24 ELSE 12 END AS total_hours, coalesce(contains(upper({HOURS}), '24H'), false) AS is_24h FROM part""",
)
def sc23(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in pricing.schedule_hours(hours()).items()])


def hours():
    k = F.col("p_partkey") % 4
    return F.when(k == 0, "L-V 08:00-20:00").when(k == 1, "24h S").when(k == 2, "sense dades")


@query(
    "sc24_schedule_days",
    f"""SELECT p_partkey, coalesce(len(regexp_extract_all({HOURS}, '\\d{{2}}:\\d{{2}}-\\d{{2}}:\\d{{2}}')) > 0, false) AS has_restrictions,
        CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS n_days FROM part""",
)
def sc24(spark, sf):
    f = pricing.schedule_text_features(hours())
    days = F.when(f["restricted_days"].isNotNull(), F.size(f["restricted_days"]))
    return table(spark, sf, "part").select("p_partkey", f["has_restrictions"].alias("has_restrictions"), days.alias("n_days"))


@query("sc25_26_capacity", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 5.0) AS BIGINT) AS spaces, CAST(floor(l_tax * 111000 / 5.0) AS BIGINT) AS spaces_degrees FROM lineitem")
def sc25(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        pricing.capacity(F.col("l_extendedprice")).alias("spaces"),
        pricing.capacity(F.col("l_tax") * 111000).alias("spaces_degrees"),
    )


COUNTS = "c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY 1)"


def counts(spark, sf):
    def of(t, name):
        return F.count_if(F.col("event_type") == t).alias(name)

    return table(spark, sf, "events").groupBy("user_id").agg(of("click", "a"), of("view", "b"), of("error", "c"))


@query(
    "sc15_log_counts",
    f"WITH {COUNTS} SELECT user_id, a, b, round(ln(1 + a), 6) AS a_log1p, a > 0 AS a_present, round(ln(1 + b), 6) AS b_log1p, b > 0 AS b_present FROM c",
)
def sc15(spark, sf):
    out = pricing.with_log_counts(counts(spark, sf).drop("c"), ["a", "b"])
    return out.withColumns({n: F.round(n, 6) for n in ("a_log1p", "b_log1p")})


@query(
    "sc27_28_diversity_rate",
    f"""WITH {COUNTS}, v AS (SELECT *, a + 1e-9 AS x, b + 1e-9 AS y, c + 1e-9 AS z FROM c), e AS (SELECT *, -(x / (x + y + z) * ln(x / (x + y + z)) + y / (x + y + z) * ln(y / (x + y + z)) + z / (x + y + z) * ln(z / (x + y + z))) AS d FROM v)
        SELECT user_id, round(d, 6) AS diversity, a + b + c AS density, round(least(4.25, 2.0 * least(2.0, 1.0 + (a + b + c) / 50.0) * (1.0 + d / 2.0) * CASE WHEN a > 3 THEN 1.25 ELSE 1.0 END * CASE WHEN b > 50 THEN 1.5 ELSE 1.0 END), 6) AS rate FROM e""",
)
def sc27(spark, sf):
    c = counts(spark, sf)
    cols = [F.col(n) for n in ("a", "b", "c")]
    dense, diverse = pricing.density(cols), pricing.diversity(cols)
    rate = pricing.dynamic_rate(dense, diverse, F.col("a"), F.col("b"))
    return c.select("user_id", F.round(diverse, 6).alias("diversity"), dense.alias("density"), F.round(rate, 6).alias("rate"))


#: Categories by tag; None is any value.
POI_CATEGORIES = {
    "sustenance": {"amenity": ["restaurant", "cafe", "fast_food", "pub", "bar"]},
    "shop": {"shop": None},
    "education": {"amenity": ["school", "university", "college", "kindergarten"]},
    "health": {"amenity": ["hospital", "clinic", "doctors", "pharmacy"]},
    "transport": {"public_transport": ["stop_position", "platform", "station"], "highway": ["bus_stop"]},
    "leisure": {"leisure": None},
    "tourism": {"tourism": ["hotel", "hostel", "guest_house", "motel", "attraction"]},
    "parking_poi": {"amenity": ["parking", "parking_entrance", "parking_space"]},
    "finance": {"amenity": ["bank", "atm"]},
}


def in_category(tags, wanted: dict):
    """Whether any tag has a wanted value (case aside), or any value but the empty one where None is wanted."""
    out = F.lit(False)
    for key, values in wanted.items():
        value = F.try_element_at(tags, F.lit(key))
        hit = (value != "") if values is None else F.lower(value).isin(values)
        out = out | F.coalesce(hit, F.lit(False))
    return out


@query(
    "sc30_poi_categories",
    """SELECT CASE p_partkey % 4 WHEN 0 THEN 'sustenance' WHEN 1 THEN 'shop' WHEN 2 THEN 'transport' ELSE 'none' END AS category, count(*) AS n FROM part GROUP BY 1""",
)
def sc30(spark, sf):
    k = F.col("p_partkey") % 4
    tags = (
        F.when(k == 0, F.create_map(F.lit("amenity"), F.lit("Cafe")))
        .when(k == 1, F.create_map(F.lit("shop"), F.lit("bakery")))
        .when(k == 2, F.create_map(F.lit("highway"), F.lit("bus_stop")))
        .otherwise(F.create_map(F.lit("shop"), F.lit("")))
    )
    case = F.lit("none")
    for name, wanted in reversed(POI_CATEGORIES.items()):
        case = F.when(in_category(tags, wanted), name).otherwise(case)
    return table(spark, sf, "part").groupBy(case.alias("category")).agg(F.count("*").alias("n"))


@query(
    "sc31_poi_type",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'shop' WHEN p_partkey % 5 = 1 THEN p_type WHEN p_partkey % 5 = 2 THEN p_brand ELSE p_name END AS poi_type FROM part""",
)
def sc31(spark, sf):
    k = F.col("p_partkey") % 5
    shop = F.when(k == 0, F.lit("x"))
    amenity, tourism = F.when(k == 1, F.col("p_type")), F.when(k == 2, F.col("p_brand"))
    leisure = F.col("p_name")
    kind = F.when(shop.isNotNull(), "shop").otherwise(F.coalesce(amenity, tourism, leisure, shop))
    return table(spark, sf, "part").select("p_partkey", kind.alias("poi_type"))
