"""Queries of spatial operators; two embedding dimensions stand for places."""

from __future__ import annotations

from pyspark.sql import functions as F

from curbflow.operators import spatial as sp
from curbflow.sources.landing import read_csv, read_geometries
from curbflow.sources.scratch import new_folder

from .registry import query, table

XY = "xy AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS y2 FROM embeddings)"
D = """CASE WHEN (s.x2-s.x)*(s.x2-s.x)+(s.y2-s.y)*(s.y2-s.y) > 0 THEN greatest(0.0, least(1.0, ((p.x-s.x)*(s.x2-s.x)+(p.y-s.y)*(s.y2-s.y)) / ((s.x2-s.x)*(s.x2-s.x)+(s.y2-s.y)*(s.y2-s.y)))) ELSE 0.0 END"""
SEGMENTS = f"""{XY}, near AS (SELECT s.vec_id AS seg, p.vec_id AS place, p.label, sqrt(pow(p.x - s.x - t*(s.x2-s.x), 2) + pow(p.y - s.y - t*(s.y2-s.y), 2)) AS d
 FROM (SELECT s.*, p.vec_id AS pid, {D} AS t FROM xy s, xy p) s JOIN xy p ON s.pid = p.vec_id)"""


def places(spark, sf):
    at = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "x2", "y2"))]
    return table(spark, sf, "embeddings").select("vec_id", "label", *at)


def segments(spark, sf):
    line, _ = sp.line_or_reason(*map(F.col, ("x", "y", "x2", "y2")))
    return places(spark, sf).select(F.col("vec_id").alias("seg"), line.alias("line"))


@query(
    "j11_distance_join",
    f"""WITH {SEGMENTS} SELECT seg, place, round(d, 6) AS distance FROM near WHERE d <= 0.05""",
)
def j11(spark, sf):
    return sp.pairs_within(segments(spark, sf), places(spark, sf).select(F.col("vec_id").alias("place"), "x", "y"), 0.05, ["seg", "place"], decimals=6)


@query(
    "a25_category_counts",
    f"WITH {SEGMENTS} SELECT seg, "
    + ", ".join(f'count(*) FILTER (label = {c} AND d <= {r}) AS "poi_{c}_count_{r * 1000:g}m", count(*) FILTER (label = {c} AND d <= {r}) > 0 AS "poi_{c}_present_{r * 1000:g}m"' for c in (0, 1) for r in (0.02, 0.05, 0.1))
    + " FROM near GROUP BY 1",
)
def a25(spark, sf):
    return sp.category_counts(segments(spark, sf), places(spark, sf).select("label", "x", "y"), "seg", "label", [0, 1], [0.02, 0.05, 0.1], unit=1000)


@query(
    "j12_nearest",
    f"""WITH {XY}, d AS (SELECT a.vec_id, b.vec_id AS place, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM xy a, xy b WHERE a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, place) AS k FROM d) SELECT vec_id, place, round(d, 6) AS distance FROM r WHERE k = 1""",
)
def j12(spark, sf):
    p = places(spark, sf)
    stops = p.select(F.col("vec_id").alias("place"), "x", "y")
    return sp.nearest(p, stops, "vec_id", "place", 0.02, other=True).withColumn("distance", F.round("distance", 6))


@query(
    "j13_stop_density",
    f"""WITH {XY} SELECT a.vec_id, count(b.vec_id) AS n FROM xy a LEFT JOIN xy b ON b.vec_id <> a.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05 GROUP BY 1""",
)
def j13(spark, sf):
    return sp.others_within(places(spark, sf), "vec_id", 0.05)


@query("sp1_points", f"WITH {XY} SELECT count(*) AS n, round(avg(x), 6) AS mean_x FROM xy")
def sp1(spark, sf):
    p = sp.points(places(spark, sf), "x", "y")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("point.x"), 6).alias("mean_x"))


N, LON, LAT = 1 / 298.257223563 / (2 - 1 / 298.257223563), "radians(2.17 + x / 10)", "radians(41.39 + y / 10)"
_ROOT = 2 * N**0.5 / (1 + N)
_SERIES = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
_RADIUS = 0.9996 * 6378137.0 / (1 + N) * (1 + N**2 / 4 + N**4 / 64)


@query(
    "sp2_projection",
    f"""WITH {XY}, a AS (SELECT vec_id, {LON} - radians(3) AS lam, sinh(atanh(sin({LAT})) - {_ROOT} * atanh({_ROOT} * sin({LAT}))) AS t FROM xy),
        b AS (SELECT vec_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
        SELECT vec_id, round(500000.0 + {_RADIUS} * (eta + {" + ".join(f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_SERIES, 1))}), 3) AS easting,
          round({_RADIUS} * (xi + {" + ".join(f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_SERIES, 1))}), 3) AS northing FROM b""",
)
def sp2(spark, sf):
    lon, lat = 2.17 + F.col("x") / 10, 41.39 + F.col("y") / 10
    east, north = sp.utm(lon, lat)
    return places(spark, sf).select("vec_id", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query(
    "sp3_6_length_centroid",
    f"""WITH {XY} SELECT vec_id AS seg, round(sqrt(pow(x - x2, 2) + pow(y - y2, 2)), 6) AS length, round((x + x2) / 2, 6) AS cx, round((y + y2) / 2, 6) AS cy FROM xy""",
)
def sp3(spark, sf):
    s = segments(spark, sf)
    c = sp.centroid(F.col("line"))
    return s.select("seg", F.round(sp.line_length(F.col("line")), 6).alias("length"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(
    "sp4_line_validity",
    f"""WITH {XY} SELECT CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'zero length' ELSE 'valid' END AS reason, count(*) AS n FROM xy GROUP BY 1""",
)
def sp4(spark, sf):
    p = places(spark, sf)
    x1 = F.when(F.col("vec_id") % 7 != 0, F.col("x"))
    same = F.col("vec_id") % 11 == 0
    x2, y2 = F.when(same, F.col("x")).otherwise(F.col("x2")), F.when(same, F.col("y")).otherwise(F.col("y2"))
    _, reason = sp.line_or_reason(x1, F.col("y"), x2, y2)
    return p.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "sp5_usable_coordinates",
    f"""WITH {XY} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 2 ELSE 3 END AS n_points FROM xy""",
)
def sp5(spark, sf):
    def point(*v):
        return F.array(*v)

    one = point(F.col("x"), F.col("y"))
    other = point(F.col("x2"), F.col("y2"))
    bad = point(F.col("x"))
    raw = F.when(F.col("vec_id") % 3 == 0, F.array(one, bad)).when(F.col("vec_id") % 3 == 1, F.array(one, bad, other)).otherwise(F.array(one, other, one))
    return places(spark, sf).select("vec_id", F.size(sp.usable_line(raw)).alias("s")).select("vec_id", F.when(F.col("s") > 0, F.col("s")).alias("n_points"))


@query(
    "sp5_geometry_kinds",
    f"""WITH {XY} SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'MultiLineString' WHEN 3 THEN 'Polygon' WHEN 4 THEN 'MultiPolygon'
          WHEN 5 THEN 'LineString' WHEN 6 THEN 'MultiLineString' WHEN 7 THEN 'Polygon' WHEN 8 THEN 'GeometryCollection' ELSE 'Point' END AS kind,
        CASE vec_id % 10 WHEN 5 THEN 'too few points' WHEN 6 THEN 'too few points' WHEN 7 THEN 'not numbers' WHEN 8 THEN 'unsupported kind' ELSE 'usable' END AS reason,
        CASE vec_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 9 THEN 1 END AS n_lines, CASE vec_id % 10 WHEN 3 THEN 1 WHEN 4 THEN 1 END AS n_polygons,
        CASE vec_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 7 WHEN 4 THEN 3 WHEN 9 THEN 1 END AS n_points,
        round(CASE WHEN vec_id % 10 IN (0, 9) THEN x WHEN vec_id % 10 = 1 THEN x + x2 WHEN vec_id % 10 = 2 THEN 3 * x + 2 * x2 WHEN vec_id % 10 = 3 THEN 4 * x + 3 * x2 WHEN vec_id % 10 = 4 THEN 2 * x + x2 END, 6) AS sum_x FROM xy""",
)
def sp5_kinds(spark, sf):
    """Geometries of all kinds, some not usable, landed as lines of JSON and read back."""
    a, b = F.array("x", "y"), F.array("x2", "y2")
    short = F.array(F.col("x"))
    ring = F.array(a, b, a, a)
    of = {
        0: ("Point", a),
        1: ("LineString", F.array(a, short, b)),
        2: ("MultiLineString", F.array(F.array(a, b), F.array(a), F.array(a, b, a, short))),
        3: ("Polygon", F.array(ring, F.array(b, b, a))),
        4: ("MultiPolygon", F.array(F.array(F.array(a, b)), F.array(F.array(a, b, a)))),
        5: ("LineString", F.array(a, short)),
        6: ("MultiLineString", F.array(F.array(a), F.array(short))),
        7: ("Polygon", F.array(F.array(a, F.array(F.lit(None).cast("double"), F.col("y")), b))),
        8: ("GeometryCollection", F.array(a)),
        9: ("Point", a),
    }
    way = F.col("vec_id") % 10
    kind = F.coalesce(*[F.when(way == k, F.lit(name)) for k, (name, _) in of.items()])
    text = F.coalesce(*[F.when(way == k, F.to_json(c)) for k, (_, c) in of.items()])
    folder = new_folder(spark, "geometry")
    geometry = F.concat(F.lit('{"type": "'), kind, F.lit('", "coordinates": '), text, F.lit("}"))
    places(spark, sf).select(F.concat(F.lit('{"id": '), F.col("vec_id"), F.lit(', "geometry": '), geometry, F.lit("}")).alias("value")).write.text(folder)
    rows = read_geometries(spark, folder)
    typed = rows.withColumns(sp.typed_geometry(F.col("kind"), F.col("coordinates")))
    points = F.coalesce(F.flatten("parts"), F.flatten(F.flatten("polygons")))
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"])
    counts = {"n_lines": F.when(F.col("parts").isNotNull(), F.size("parts")), "n_polygons": F.when(F.col("polygons").isNotNull(), F.size("polygons"))}
    typed = typed.withColumns(counts | {"n_points": F.when(points.isNotNull(), F.size(points)), "sum_x": F.round(total, 6)})
    return typed.select(F.col("id").alias("vec_id"), "kind", "reason", "n_lines", "n_polygons", "n_points", "sum_x")


@query(
    "sp7_point_in_polygon",
    f"""WITH {XY} SELECT vec_id, x > -0.1 AND x < 0.1 AND y > -0.05 AND y < 0.15 AS inside FROM xy""",
)
def sp7(spark, sf):
    corners = [(-0.1, -0.05), (0.1, -0.05), (0.1, 0.15), (-0.1, 0.15)]
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in corners])
    return places(spark, sf).select("vec_id", sp.in_polygon(F.col("x"), F.col("y"), ring).alias("inside"))


@query(
    "sp11_degree_distance",
    f"WITH {XY} SELECT vec_id, round(sqrt(pow(x - x2, 2) + pow(y - y2, 2)) * 111000, 4) AS metres FROM xy",
)
def sp11(spark, sf):
    d = sp.degree_distance(*map(F.col, ("x", "y", "x2", "y2")))
    return places(spark, sf).select("vec_id", F.round(d, 4).alias("metres"))


@query("sp12_service_frequency", "SELECT l_suppkey AS stop_id, round(count(*) / 24.0, 6) AS trips_per_hour FROM lineitem GROUP BY 1")
def sp12(spark, sf):
    stop_times = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stop_id"))
    return sp.service_frequency(stop_times).withColumn("trips_per_hour", F.round("trips_per_hour", 6))


@query(
    "sp13_route_coverage",
    """SELECT s_nationkey AS zone, count(DISTINCT o_custkey) AS n_routes FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def sp13(spark, sf):
    pairs = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("stop_id"))
    times = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("stop_id"), F.col("l_orderkey").alias("trip_id"))
    trips = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"))
    return sp.route_coverage(pairs, times, trips, "zone")


@query(
    "sp14_density_clusters",
    f"""WITH RECURSIVE {XY}, n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM xy a JOIN xy b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.012),
        core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4), e AS (SELECT n.a, n.b FROM n JOIN core c ON n.a = c.a JOIN core d ON n.b = d.a),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        l AS (SELECT a, min(b) AS label FROM r GROUP BY 1),
        edge AS (SELECT n.a, min(l.label) AS label FROM n JOIN l ON n.b = l.a GROUP BY 1),
        names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM l))
        SELECT xy.vec_id, CAST(coalesce(names.cluster, -1) AS INTEGER) AS cluster FROM xy LEFT JOIN l ON xy.vec_id = l.a LEFT JOIN edge ON xy.vec_id = edge.a LEFT JOIN names ON coalesce(l.label, edge.label) = names.label""",
)
def sp14(spark, sf):
    return sp.density_clusters(places(spark, sf), "vec_id", 0.012, 4)


@query(
    "io10_wkt",
    f"WITH {XY} SELECT vec_id AS seg, round(x, 4) AS x, round(y2, 4) AS y2, 2 AS n_points FROM xy",
)
def io10(spark, sf):
    """Lines as text, written as CSV and read back."""
    folder = new_folder(spark, "wkt")
    segments(spark, sf).select("seg", sp.wkt_line(F.col("line")).alias("wkt")).write.option("header", True).csv(folder)
    pairs = F.split(F.regexp_extract("wkt", r"LINESTRING \((.*)\)", 1), ", ")

    def number(pair, at):
        return F.round(F.split(pairs[pair], " ")[at].cast("double"), 4)

    lines = read_csv(spark, folder, "seg BIGINT, wkt STRING")
    return lines.select("seg", number(0, 0).alias("x"), number(1, 1).alias("y2"), F.size(pairs).alias("n_points"))


@query(
    "pf20_boundary_filter",
    f"""WITH {XY} SELECT vec_id, label AS zone FROM xy WHERE x > -0.1 - label / 50.0 AND x < 0.1 AND y > -0.05 AND y < 0.15""",
)
def pf20(spark, sf):
    """Points inside the boundary of their zone, from a table of one ring a zone."""
    zones = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")).where("label is not null")
    left = -0.1 - F.col("label") / 50.0
    ring = F.array(*[F.struct(a.alias("x"), F.lit(b).alias("y")) for a, b in ((left, -0.05), (F.lit(0.1), -0.05), (F.lit(0.1), 0.15), (left, 0.15))])
    boundaries = zones.select(F.col("label").alias("zone"), ring.alias("ring"))
    return sp.within_boundary(places(spark, sf).withColumn("zone", F.col("label")), boundaries, "zone").select("vec_id", "zone")


@query(
    "sp17_rejected_geometry",
    f"""WITH {XY} SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'no coordinates' WHEN 1 THEN 'not finite' WHEN 2 THEN 'too few points' WHEN 3 THEN 'no length' ELSE 'usable' END AS reason,
        CASE WHEN vec_id % 5 = 4 THEN 2 END AS n_points FROM xy""",
)
def sp17(spark, sf):
    def point(x, y):
        return F.array(x, y)

    one, other = point(F.col("x"), F.col("y")), point(F.col("x2"), F.col("y2"))
    kind = F.col("vec_id") % 5
    raw = F.when(kind == 1, F.array(one, point(F.lit(float("nan")), F.col("y")))).when(kind == 2, F.array(one)).when(kind == 3, F.array(one, one)).when(kind == 4, F.array(one, other))
    line, reason = sp.repaired_line(raw)
    return places(spark, sf).select("vec_id", reason.alias("reason"), F.when(line.isNotNull(), F.size(line)).alias("n_points"))
