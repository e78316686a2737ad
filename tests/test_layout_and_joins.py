"""Range layouts, edge-wise distance joins, as-of joins over dense times, and interval flags, against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curbflow.functions import calendars, pricing
from curbflow.operators import joins, spatial
from curbflow.operators.layout import with_row_index
from curbflow.operators.profile import exact_quantiles
from curbflow.sources import landing


@pytest.mark.parametrize("adaptive", ("true", "false"))
def test_row_index_is_a_permutation(spark, adaptive):
    n = 1_000_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"), F.lit(1).alias("row"))
        got = with_row_index(df.repartition(8), ["k"], "place")
        assert got.columns == ["k", "id", "text", "row", "place"]
        got = got.selectExpr("place", "k", "lag(k) OVER (PARTITION BY place DIV 1000 ORDER BY place) AS before")
        stats = got.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place"), F.count_if(F.col("before") > F.col("k"))).first()
        assert tuple(stats) == (n, n, 0, n - 1, 0)
        edges = got.where("place % 1000 IN (0, 999)").orderBy("place").select("k").collect()
        assert all(a["k"] <= b["k"] for a, b in zip(edges, edges[1:], strict=False))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_row_index_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (2,), (2,), (1,), (None,)], "v int")
    assert [(r["row"], r["v"]) for r in with_row_index(df, ["v"]).orderBy("row").collect()] == [(0, None), (1, None), (2, 1), (3, 2), (4, 2)]
    assert with_row_index(df.where("false"), ["v"]).collect() == []


def test_quantiles_of_many_values(spark):
    df = spark.range(200_001).select((F.col("id") * 7919 % 200_001).cast("double").alias("v"), F.lit("pad").alias("x"))
    assert exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).first()["quantiles"] == [0.0, 50_000.0, 100_000.0, 200_000.0]


def to_edge(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / square)) if square else 0.0
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


@pytest.mark.parametrize("radius", (0.05, 0.4, 3.0))
def test_distance_join_of_bent_lines(spark, radius):
    rng = random.Random(7)
    lines = [(i, [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(rng.randrange(2, 7))]) for i in range(40)]
    lines += [(50, [(0.0, 0.0), (0.0, 0.0)]), (51, [(-1.0, 0.5), (1.0, 0.5), (-1.0, 0.5)]), (52, [(0.5, -1.0), (0.5, 1.0)]), (53, None)]
    places = [(i, rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5)) for i in range(400)] + [(500, 0.5, 0.5), (501, 0.5 + radius, 0.25), (502, None, 1.0)]
    a = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p] if p else None) for i, p in lines], "seg int, line array<struct<x: double, y: double>>")
    b = spark.createDataFrame(places, "place int, x double, y double")
    got = sorted((r["seg"], r["place"]) for r in spatial.pairs_within(a, b, radius).collect())
    want = {
        (s, p): min(to_edge(x, y, q, r) for q, r in zip(line, line[1:], strict=False))
        for s, line in lines if line for p, x, y in places if x is not None
    }
    assert got == sorted(k for k, d in want.items() if d <= radius) and len(got) > 20


def test_long_edges_list_cells_along_themselves(spark):
    """A slanted edge of 1000 radii comes near some thousands of cells, not the million of its box."""
    line = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 700.0, "y": 700.0}])], "seg int, line array<struct<x: double, y: double>>")
    assert spatial.edge_cells(line, 1.0).count() < 6000


def test_asof_of_dense_times(spark):
    """A million readings within one tolerance: each is looked at a fixed number of times."""
    base = datetime(2024, 1, 1)
    right = spark.range(300_000).select((F.lit(base).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id / 100.0)")).alias("rt"), "id")
    left = spark.createDataFrame([(base + timedelta(seconds=s),) for s in (0.004, 0.005, 1.237, 2999.99, 3599.0, 6600.0)], "t timestamp_ntz")
    got = joins.asof_nearest(left, right, "t", "rt", 3600).orderBy("t").collect()
    assert [r["id"] for r in got] == [0, 0, 124, 299_999, 299_999, None]


@pytest.mark.parametrize("seed", range(3))
def test_asof_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    right = sorted({rng.randrange(0, 5000) for _ in range(60)})
    left = [rng.randrange(-200, 5300) for _ in range(200)] + right[:5]
    r = spark.createDataFrame([(base + timedelta(seconds=s), s) for s in right], "rt timestamp_ntz, v int")
    asks = spark.createDataFrame([(i, base + timedelta(seconds=s)) for i, s in enumerate(left)] + [(999, None)], "i int, t timestamp_ntz")
    got = {x["i"]: x["v"] for x in joins.asof_nearest(asks, r, "t", "rt", 60).collect()}
    want = {i: min((abs(s - v), v) for v in right) for i, s in enumerate(left)}
    assert got == {i: v if d <= 60 else None for i, (d, v) in want.items()} | {999: None}


def test_interval_flag_does_not_shuffle_the_rows(spark):
    intervals = spark.createDataFrame([(datetime(2024, 1, 1, 8), datetime(2024, 1, 2, 3)), (datetime(2024, 1, 2, 2), datetime(2024, 1, 2, 4))], "start timestamp_ntz, end timestamp_ntz")
    rows = spark.createDataFrame([(datetime(2024, 1, d, h),) for d in (1, 2) for h in (7, 8, 3, 4, 5)] + [(None,)], "ts timestamp_ntz")
    flagged = calendars.with_interval_flag(rows, "ts", intervals, "f")
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    panel = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert "LeftOuter, BuildRight" in panel and "SortMergeJoin" not in plan
    got = {(r["ts"].day, r["ts"].hour) for r in flagged.where("f = 1").collect()}
    assert got == {(1, 8), (2, 3), (2, 4)} and flagged.count() == 11


def test_rejected_lines_are_counted(spark, tmp_path):
    head = "idTram,data,estatActual,estatPrevist\n"
    (tmp_path / "2022_01_A_TRAMS_TRAMS.csv").write_text(head + "1,20220101000000,3,2\nx,y\n2,20220101000000,two,2\n")
    (tmp_path / "2022_02_B_TRAMS_TRAMS.csv").write_text(head + "3,20220201000000,3,2\n1,2,3,4,5\n")
    (tmp_path / "2023_01_A_TRAMS_TRAMS.csv").write_text(head + "9,20230101000000,3,2\n")
    (tmp_path / "notes_TRAMS_TRAMS.csv").write_text("x\n")
    paths = landing.files_of_months(spark, str(tmp_path), "2022-01", "2022-12")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["2022_01_A_TRAMS_TRAMS.csv", "2022_02_B_TRAMS_TRAMS.csv"]
    counts = {r["file_name"][:7]: (r["n_good"], r["n_bad"]) for r in landing.line_counts(spark, paths, landing.HISTORY_SCHEMA).collect()}
    assert counts == {"2022_01": (1, 2), "2022_02": (1, 1)}
    assert sorted(r["line"] for r in landing.rejected_lines(spark, paths, landing.HISTORY_SCHEMA).collect()) == ["1,2,3,4,5", "2,20220101000000,two,2", "x,y"]
    rows = landing.read_history(spark, str(tmp_path), "2022-02", "2022-12")
    assert [p.rsplit("/", 1)[1] for p in rows.inputFiles()] == ["2022_02_B_TRAMS_TRAMS.csv"] and [r["segment_id"] for r in rows.collect()] == [3]
    assert landing.read_history(spark, str(tmp_path), "2030-01", "2030-02").collect() == []
    # a column that is asked for alone drops the same lines
    assert landing.read_csv(spark, paths, landing.HISTORY_SCHEMA).select("estatPrevist").count() == 2


def test_every_part_of_a_schedule_is_a_rule_or_a_reject(spark):
    texts = ["de Dl a Dv de 08:00 a 14:00 i de 16:00 a 20:00, Ds de 09:00 a 14:00", "consulteu", "de 8:00 a 9:00", "fins 8:00 a 9:00, Dg tancat", "", None]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "schedule_id int, description string, includes_holidays int")
    parts = {(r["schedule_id"], r["part"].strip(), r["reason"]) for r in pricing.schedule_parts(df).collect()}
    assert {(i, why) for i, _, why in parts} == {(0, None), (1, "neither day nor slot"), (2, None), (3, "no day"), (3, "no slot")}
    rules = pricing.schedule_rules(df).collect()
    assert sorted((r["schedule_id"], r["days"], r["start_sec"]) for r in rules) == [(0, [0, 1, 2, 3, 4], 28800), (0, [0, 1, 2, 3, 4], 57600), (0, [5], 32400), (2, None, 28800)]
    assert {r["schedule_id"] for r in pricing.rejected_parts(df).collect()} == {1, 3}


def test_geometry_of_every_kind(spark):
    rows = [
        ("Point", "[1.0, 2]"), ("Point", "[1.0]"), ("LineString", "[[1, 2], [3, 4], [5]]"), ("MultiLineString", "[[[1, 2], [3, 4]], [[5, 6]]]"),
        ("Polygon", "[[[0, 0], [1, 0], [1, 1]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2]]]"), ("Polygon", "[[[0, 0], [1, 0]]]"),
        ("MultiPolygon", "[[[[0, 0], [1, 0], [1, 1]]], [[[0, 0]]], []]"), ("MultiPolygon", "[]"), ("Circle", "[1, 2]"), (None, "[1, 2]"), ("Point", None),
        ("LineString", '[["a", 1], [2, 3]]'), ("LineString", "not json"),
    ]
    df = spark.createDataFrame(rows, "kind string, coordinates string")
    got = df.withColumns(spatial.typed_geometry(F.col("kind"), F.col("coordinates"))).collect()
    assert [r["reason"] for r in got] == [
        "usable", "too few points", "usable", "usable", "usable", "too few points", "usable", "too few points", "unsupported kind", "no geometry", "no geometry",
        "not numbers", "not numbers",
    ]
    sizes = [None if r["parts"] is None else [len(x) for x in r["parts"]] for r in got[:4]]
    assert sizes == [[1], None, [2], [2]]
    assert [[len(ring) for ring in p] for p in got[4]["polygons"]] == [[3, 3]] and len(got[6]["polygons"]) == 1
    assert all(r["parts"] is None for r in got[4:])


def test_asof_join_is_no_broadcast(spark):
    """The rows found for each distinct time go back to the left side by shuffles, however small they seem."""
    left = spark.range(300).select(F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("ts"))
    right = spark.range(30).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("r"), F.col("id").alias("v"))
    bounded, unbounded = joins.asof_nearest(left, right, "ts", "r", 60), joins.asof_nearest_unbounded(left, right, "ts", "r")
    for out in (bounded, unbounded):
        assert out.count() == 300
        plan = out._jdf.queryExecution().sparkPlan().toString()
        top = [line for line in plan.splitlines() if "Join" in line][0]
        assert "SortMergeJoin" in top and "__t" in top
