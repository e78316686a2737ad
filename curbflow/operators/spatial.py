"""Geometry as coordinate arrays, and spatial joins as grid equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, log2, radians, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from curbflow.operators.cells import Cells, first_nearest
from curbflow.operators.layout import with_row_index
from curbflow.operators.strips import Strips, counts_near
from curbflow.sources.scratch import checkpointed, written

#: The WGS84 / GRS80 ellipsoid's half axis and flattening (they agree to the millimetre), UTM scale.
HALF_AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input: by shuffles, never through the driver.

    What explode makes of a table isn't in its estimated size, and even a small
    broadcast takes a page of the driver's memory, in loops one for each join.
    """
    return left.join(right.hint("merge"), on, how)


def utm(lon: Column, lat: Column, zone: int = 31) -> tuple[Column, Column]:
    """Easting and northing in metres on a northern UTM zone: transverse Mercator by Krueger's series to order 3."""
    n = FLATTENING / (2 - FLATTENING)
    radius = HALF_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    root = 2 * sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon) - radians(6 * zone - 183)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - root * F.atanh(root * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(series, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + SCALE * radius * east, SCALE * radius * north


def points(df: DataFrame, x: str, y: str, name: str = "point") -> DataFrame:
    """Rows with both coordinates, and the point as a struct."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(ok).withColumn(name, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))


def edges(line: Column) -> Column:
    """Consecutive point pairs of an array of points."""
    rest = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    head = F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    return F.zip_with(head, rest, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edge_length(e: Column) -> Column:
    return F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"])


def line_length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda total, e: total + edge_length(e))


def centroid(line: Column) -> Column:
    """Mean of the edges' middles by length; a line without length has its first point."""
    total = line_length(line)

    def mean(axis: str) -> Column:
        weighted = F.aggregate(
            edges(line), F.lit(0.0), lambda s, e: s + edge_length(e) * (e["a"][axis] + e["b"][axis]) / 2
        )
        return F.when(total > 0, weighted / total).otherwise(F.element_at(line, 1)[axis])

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def line_or_reason(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """A line from end points, and why it is none."""
    missing = x1.isNull() | y1.isNull() | x2.isNull() | y2.isNull()
    same = (x1 == x2) & (y1 == y2)
    ends = F.array(F.struct(x1.alias("x"), y1.alias("y")), F.struct(x2.alias("x"), y2.alias("y")))
    return F.when(~missing & ~same, ends), F.when(missing, "missing").when(same, "zero length").otherwise("valid")


def usable_line(coordinates: Column) -> Column:
    """An array of [x, y] arrays as points; malformed points are skipped, and fewer than two make null."""
    good = F.filter(coordinates, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    line = F.transform(good, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.when(F.size(line) >= 2, line)


#: Depth of nesting of each kind's coordinates above a point's, and the least points of its lines or outer rings.
GEOMETRY_KINDS = {"Point": (0, 1), "LineString": (1, 2), "MultiLineString": (2, 2), "Polygon": (2, 3), "MultiPolygon": (3, 3)}


def typed_geometry(kind: Column, coordinates: Column) -> dict[str, Column]:
    """parts, polygons and reason of a geometry of any kind, from its JSON coordinates.

    Every kind is read as polygons (arrays of rings, arrays of points).  What
    isn't a pair is skipped; then lines with fewer than two points, and polygons
    whose outer ring has fewer than three, are skipped, and a geometry of which
    nothing is left has a reason and nulls.  ``parts`` are the lines of a point or line
    (a point is a line of one), ``polygons`` the rings of an area, outer first.
    """
    pair = "array<double>"
    nested = [pair, f"array<{pair}>", f"array<array<{pair}>>", f"array<array<array<{pair}>>>"]
    read = [F.from_json(coordinates, t) for t in nested]
    depth = {d: kind.isin([k for k, (n, _) in GEOMETRY_KINDS.items() if n == d]) for d in range(4)}
    # a point, a line and a multi-line are one polygon of lines, so that all kinds have one shape
    shape = F.when(depth[0], F.array(F.array(F.array(read[0])))).when(depth[1], F.array(F.array(read[1]))).when(depth[2], F.array(read[2])).when(depth[3], read[3])

    def ring(points_: Column) -> Column:
        pairs = F.filter(points_, lambda p: F.size(p) == 2)
        return F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    rings = F.transform(shape, lambda part: F.transform(F.coalesce(part, F.array().cast(nested[2])), ring))
    number = F.forall(rings, lambda part: F.forall(part, lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())))
    least = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, (_, n) in GEOMETRY_KINDS.items()])
    area = kind.isin("Polygon", "MultiPolygon")
    lines = F.filter(F.flatten(rings), lambda r: F.size(r) >= least)
    polygons = F.filter(rings, lambda part: F.coalesce(F.size(F.get(part, F.lit(0))) >= least, F.lit(False)))
    left = F.when(area, F.size(polygons)).otherwise(F.size(lines))
    reason = (
        F.when(kind.isNull() | coordinates.isNull(), "no geometry")
        .when(~kind.isin(list(GEOMETRY_KINDS)), "unsupported kind")
        .when(shape.isNull() | ~F.coalesce(number, F.lit(False)), "not numbers")
        .when(F.coalesce(left, F.lit(0)) < 1, "too few points")
        .otherwise("usable")
    )
    ok = reason == "usable"
    return {"parts": F.when(ok & ~area, lines), "polygons": F.when(ok & area, polygons), "reason": reason}


def repaired_line(coordinates: Column) -> tuple[Column, Column]:
    """A line of finite points from [x, y] arrays, and why there is none: the reason of a reject table."""

    def number(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    finite = F.filter(coordinates, lambda p: (F.size(p) >= 2) & F.coalesce(number(p[0]) & number(p[1]), F.lit(False)))
    line = F.transform(finite, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    reason = (
        F.when(coordinates.isNull() | (F.size(coordinates) == 0), "no coordinates")
        .when((F.size(finite) < 2) & (F.size(finite) < F.size(coordinates)), "not finite")
        .when(F.size(finite) < 2, "too few points")
        .when(~(line_length(line) > 0), "no length")
        .otherwise("usable")
    )
    return F.when(reason == "usable", line), reason


def within_boundary(points_: DataFrame, boundaries: DataFrame, zone: str) -> DataFrame:
    """The points (x, y) inside the ring of their zone, from a table (zone, ring); zones without a ring keep none."""
    return points_.join(boundaries, zone).where(in_polygon(F.col("x"), F.col("y"), F.col("ring"))).drop("ring")


def wkt_line(line: Column) -> Column:
    pairs = F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")"))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of points, by ray casting."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    crossings = F.aggregate(
        edges(closed),
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def distances_to_edges(x: Column, y: Column, line: Column) -> Column:
    """Distances from a point to each edge of a line."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / square).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)

    return F.transform(edges(line), to_edge)


def point_line_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance from a point to the nearest place of a line."""
    return F.array_min(distances_to_edges(x, y, line))


def finite(*columns: Column) -> Column:
    each = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for v in columns]
    return reduce(lambda a, b: a & b, each)


def edge_cells(lines: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """lines (line) with a row for each edge and grid cell (__cx, __cy) that a place within ``radius`` of the edge may have.

    Cells are ``size`` wide, or as wide as the radius; an edge whose ends aren't
    finite has none.  An edge walks through the rows of cells that it comes near.  In each it is
    clipped to the row's band, widened by the radius, and lists the cells from
    the clipped part's least to its greatest x, widened likewise.  So the
    number of cells grows with the edge's length and not with its box.
    """
    size = size or radius
    pad = radius * (1 + 1e-9)

    def cell(v: Column) -> Column:
        return F.floor(v / size)

    each = lines.select("*", F.posexplode(edges(F.col("line"))).alias("__edge", "__e")).select(
        "*", *[F.col(f"__e.{end}.{axis}").cast("double").alias(f"__{end}{axis}") for end in "ab" for axis in "xy"]
    )
    ax, ay, bx, by = map(F.col, ("__ax", "__ay", "__bx", "__by"))
    each = each.where(finite(ax, ay, bx, by))
    rows = F.sequence(cell(F.least(ay, by) - pad), cell(F.greatest(ay, by) + pad))
    each = each.drop("__e").withColumn("__cy", F.explode(rows))
    low, high = F.col("__cy") * size - pad, (F.col("__cy") + 1) * size + pad
    slope = F.nullif(by - ay, F.lit(0.0))
    t1, t2 = F.coalesce((low - ay) / slope, F.lit(0.0)), F.coalesce((high - ay) / slope, F.lit(1.0))
    inside = [F.least(F.greatest(f(t1, t2), F.lit(0.0)), F.lit(1.0)) for f in (F.least, F.greatest)]
    each = each.withColumns({"__x1": ax + inside[0] * (bx - ax), "__x2": ax + inside[1] * (bx - ax)})
    x1, x2 = F.col("__x1"), F.col("__x2")
    slack = pad + 1e-9 * (F.abs(ax) + F.abs(bx))
    columns = F.sequence(cell(F.least(x1, x2) - slack), cell(F.greatest(x1, x2) + slack))
    return each.withColumn("__cx", F.explode(columns)).drop("__x1", "__x2")


#: Locations of a tile, and lines near it, that one group meets; tiles with more have parts of either.
TILE_SPOTS, TILE_LINES = 1 << 16, 1 << 13
#: Tiles whose numbers of parts may be broadcast; those of more tiles are joined by shuffles.
FEW_TILES = 200_000


def dealt_tiles(asks: DataFrame, spots: DataFrame, ask: list[str], spot: list[str], cut: Callable[[float], tuple[Column, Column]] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Rows of asks and of spots that share a tile (__cx, __cy), in groups (__cx, __cy, __part, __slice), and the number of all pairs.

    A tile with more than ``TILE_SPOTS`` spots or ``TILE_LINES`` asks is cut into
    parts and slices by hashes of the columns ``spot`` and ``ask``; every slice
    meets every part, so each pair of a tile shares just one group.  ``cut`` makes
    other numbers of parts and slices from __n_asks, __n_spots and the number of all pairs.
    """
    tile = ["__cx", "__cy"]
    counts = [df.groupBy(*tile).agg(F.count("*").alias(n)) for df, n in ((asks, "__n_asks"), (spots, "__n_spots"))]
    counts = written(shuffled_join(*counts, tile))
    pairs = F.sum(F.col("__n_asks").cast("double") * F.col("__n_spots"))
    all_ = counts.agg(F.count("*").alias("tiles"), pairs.alias("pairs")).first()
    parts, slices = cut(all_["pairs"] or 0) if cut else (F.ceil(F.col("__n_spots") / TILE_SPOTS), F.ceil(F.col("__n_asks") / TILE_LINES))
    sizes = counts.select(*tile, slices.alias("__slices"), parts.alias("__parts"))

    def dealt(df: DataFrame, columns: list[str], mine: str, other: str) -> DataFrame:
        """df in the parts of its own number, once for each part of the other side."""
        df = df.join(F.broadcast(sizes), tile) if all_["tiles"] <= FEW_TILES else shuffled_join(df, sizes, tile)
        df = df.withColumn("__mine", F.pmod(F.xxhash64(*columns), F.col(mine)))
        return df.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("__parts", "__slices")

    left, right = dealt(asks, ask, "__slices", "__parts"), dealt(spots, spot, "__parts", "__slices")
    left = left.withColumnsRenamed({"__mine": "__slice", "__other": "__part"})
    return left, right.withColumnsRenamed({"__mine": "__part", "__other": "__slice"}), int(all_["pairs"] or 0)


#: Width of the tiles of a distance join, in radii: an edge has a row for each tile that it comes near.
TILE_RADII = 4
#: Groups and tasks of a distance join for each core, at most (a tile has one group in any case), and the pairs of a tile that are worth a group or a task.
CORE_GROUPS, CORE_TASKS, GROUP_PAIRS, FEW_PAIRS = 8, 8, 1 << 22, 1 << 22
#: Places that a task holds at once, at most, and pairs that it hands over together.
HELD_SPOTS, PAIR_ROWS = 1 << 20, 1 << 14


def pairs_within(lines: DataFrame, places: DataFrame, radius: float, keep: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """(columns of both, distance) for lines (line) and places (x, y) at most ``radius`` apart; of the columns those in ``keep``, or all.

    Distances are rounded to ``decimals``, if given, half of the last one upwards.

    Edges and places are dealt once to the tiles (``TILE_RADII`` radii wide) that
    they may meet in.  A full tile's are cut into groups by the number of cores, not of
    pairs, so what is shuffled grows with the rows; only a tile with more than
    ``HELD_SPOTS`` places has more parts.  A task holds a group's places, its edges
    stream by, and the pairs leave in blocks: neither a group's edges nor its
    pairs are held.  Of a bent line's edges the first of the least distance makes
    the pair, so none comes twice.  Null lines and places without finite
    coordinates pair with nothing.
    """

    size, tile, group = TILE_RADII * radius, ["__cx", "__cy"], ["__cx", "__cy", "__part", "__slice"]
    of_lines, of_places = ([c for c in df.columns if keep is None or c in keep] for df in (lines, places))
    ask, spot = ([f"__{side}{i}" for i in range(len(names))] for side, names in (("l", of_lines), ("p", of_places)))
    ends = ["__ax", "__ay", "__bx", "__by"]
    asks = lines.where(F.size("line") > 1).select("line", *[F.col(c).alias(n) for c, n in zip(of_lines, ask, strict=True)])
    asks = edge_cells(asks, radius, size)
    # an array costs Arrow's writer more than all other columns of a row, so it is there only if it is needed
    bends = [] if lines.where(F.size("line") > 2).isEmpty() else ["__line"]
    asks = asks.withColumn("__line", F.when(F.size("line") > 2, F.col("line"))).select(*tile, *ends, "__edge", *bends, *ask)
    x, y = (F.col(axis).cast("double") for axis in "xy")
    at = [F.floor(v / size).alias(n) for v, n in ((x, "__cx"), (y, "__cy"))]
    spots = places.where(finite(x, y)).select(*at, x.alias("__ax"), y.alias("__ay"), *[F.col(c).alias(n) for c, n in zip(of_places, spot, strict=True)])
    cores = lines.sparkSession.sparkContext.defaultParallelism
    n_asks, n_spots = F.col("__n_asks").cast("double"), F.col("__n_spots").cast("double")

    def cut(pairs: float) -> tuple[Column, Column]:
        groups = F.ceil(n_asks * n_spots / max(GROUP_PAIRS, pairs / (CORE_GROUPS * cores)))
        # the fewest copies of either side
        parts = F.least(groups, F.ceil(F.sqrt(groups * n_spots / n_asks) - 0.5))
        parts = F.greatest(parts, F.ceil(n_spots / HELD_SPOTS), F.lit(1).cast("long"))
        return parts, F.ceil(groups / parts)

    asks, spots, pairs = dealt_tiles(asks, spots, [*ask, "__edge", *ends], [*spot, "__ax", "__ay"], cut)
    tasks = max(1, min(CORE_TASKS * cores, ceil(pairs / FEW_PAIRS)))
    both = asks.withColumn("__ask", F.lit(1)).unionByName(spots.withColumn("__ask", F.lit(0)), allowMissingColumns=True)
    both = both.select(*group, "__ask", *ends, "__edge", *bends, *ask, *spot).repartition(tasks, *group).sortWithinPartitions(*group, "__ask")
    schema = StructType([*[lines.schema[c] for c in of_lines], *[places.schema[c] for c in of_places], StructField("distance", DoubleType())])

    def paired(piece: pa.RecordBatch, cells: Cells, held: pa.Table) -> Iterator[pa.RecordBatch]:
        """The pairs of a group's edges and its places."""
        found, n = [], 0
        from_to = np.column_stack([piece.column(c).to_numpy() for c in ends])
        bent = piece.column("__line").is_valid().to_numpy(zero_copy_only=False) if bends else np.zeros(len(from_to), bool)
        for edge, place, distance in cells.near(from_to, radius):
            if bends and bent[edge].any():
                mine = ~bent[edge]
                for e in np.unique(edge[~mine]):
                    rows = np.flatnonzero(edge == e)
                    vertices = piece.column("__line")[int(e)].values.flatten()
                    xy = np.column_stack([v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in vertices[:2]])
                    x_, y_ = (held.column(c).to_numpy()[place[rows]] for c in ends[:2])
                    mine[rows] = first_nearest(x_, y_, xy, piece.column("__edge")[int(e)].as_py())
                edge, place, distance = edge[mine], place[mine], distance[mine]
            found.append((edge, place, distance))
            n += len(edge)
            if n >= PAIR_ROWS:
                yield taken(piece, held, found)
                found, n = [], 0
        if n:
            yield taken(piece, held, found)

    def taken(piece: pa.RecordBatch, held: pa.Table, found: list) -> pa.RecordBatch:
        edge, place, distance = (np.concatenate(v) if len(v) > 1 else v[0] for v in zip(*found, strict=True))
        if decimals is not None:
            distance = np.floor(distance * 10.0**decimals + 0.5) / 10.0**decimals
        columns = [piece.column(c).take(pa.array(edge)) for c in ask] + [held.column(c).chunk(0).take(pa.array(place)) for c in spot]
        return pa.RecordBatch.from_arrays([*columns, pa.array(distance)], names=schema.names)

    def joined(ready: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return pa.Table.from_batches(ready).combine_chunks().to_batches() if len(ready) > 1 else ready

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by group, in each the places first."""
        now, waiting, held, cells = None, [], None, None
        ready, n = [], 0
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in [*group, "__ask"]])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if first == last:
                    continue
                piece = batch.slice(first, last - first)
                if now != (now := tuple(keys[first, :4])):
                    waiting, held = [], None
                if not keys[first, 4]:
                    waiting.append(piece.select([*ends[:2], *spot]))
                elif waiting:
                    if held is None:
                        held = pa.Table.from_batches(waiting).combine_chunks()
                        cells = Cells(*[held.column(c).to_numpy() for c in ends[:2]])
                    for some in paired(piece, cells, held):
                        ready.append(some)
                        n += some.num_rows
                        if n >= PAIR_ROWS:
                            yield from joined(ready)
                            ready, n = [], 0
        yield from joined(ready)

    return both.mapInArrow(met, schema)


def counts_near_lines(lines: DataFrame, spots: DataFrame, key: str, names: list[str], radii: list[float]) -> DataFrame:
    """(key, n_0, n_1, ...): sums of the columns ``names`` of spots (x, y) at most each radius from straight lines (line of two points).

    Sums are ordered by name, then by radius; a line has a row for each part of a
    tile that it comes near.  Tiles are as wide as the largest radius.  In a tile
    the spots lie in strips; where a strip is near a line in its whole height
    its spots are counted by two places in their order, and only those about
    the ends are measured (``strips``), so the work for a line grows with the
    root of the number of spots around it.
    """
    size = max(radii)
    tile, ends = ["__cx", "__cy"], ["__ax", "__ay", "__bx", "__by"]
    spots = written(spots.select("x", "y", *names, *[F.floor(F.col(axis) / size).alias(f"__c{axis}") for axis in "xy"]))
    asks = edge_cells(lines, size).select(*tile, key, *ends)
    left, right, _ = dealt_tiles(asks, spots, [key, *ends], ["x", "y"])

    def counted(asks_: pa.Table, spots_: pa.Table) -> pa.Table:
        found = [asks_.column(key)]
        if asks_.num_rows and spots_.num_rows:
            at = Strips(*[spots_.column(c).to_numpy() for c in "xy"], np.column_stack([spots_.column(c).to_numpy() for c in names]))
            from_to = np.column_stack([asks_.column(c).to_numpy() for c in ends])
            by_radius = [counts_near(at, from_to, r) for r in radii]
            found += [pa.array(n[:, i]) for i in range(len(names)) for n in by_radius]
        else:
            found = [asks_.column(key).slice(0, 0)] + [pa.array([], pa.int64())] * (len(names) * len(radii))
        return pa.Table.from_arrays(found, names=[key, *sums])

    sums = [f"n_{i}" for i in range(len(names) * len(radii))]
    schema = StructType([lines.schema[key], *[StructField(n, LongType()) for n in sums]])
    groups = [*tile, "__part", "__slice"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(counted, schema)


def others_within(points_: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, n) for each key of points (key, x, y): rows of other keys at most ``radius`` from its rows, counted without their pairs."""

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    x, y = (F.col(axis).cast("double").alias(axis) for axis in "xy")
    at = points_.select(key, x, y).where(F.col(key).isNotNull() & finite(F.col("x")) & finite(F.col("y")))
    spots = at.groupBy("x", "y").agg(F.count("*").alias("__n"))
    asks = at.select(key, F.array(F.struct("x", "y"), F.struct("x", "y")).alias("line"))
    near = counts_near_lines(asks, spots, key, ["__n"], [radius]).withColumnRenamed("n_0", "n")
    own = shuffled_join(at, at.select(key, F.col("x").alias("__x"), F.col("y").alias("__y")), key)
    own = own.where(F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) <= radius)
    found = near.unionByName(own.groupBy(key).agg((-F.count("*")).alias("n"))).groupBy(key).agg(F.sum("n").alias("n"))
    return shuffled_join(points_.select(key).distinct(), found, key, "left").na.fill(0, ["n"])


def category_counts(
    lines: DataFrame, places: DataFrame, key: str, category: str, categories: list, radii: list[float], unit: float = 1.0
) -> DataFrame:
    """Count and presence for each (category, radius), 0 and false where nothing is near.

    Straight lines are counted tile by tile, without their pairs; a bent line's
    edges share places, so its pairs are made, all radii from one join.
    ``unit`` is the metres that a unit of length stands for, in the columns' names.
    """

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    x, y = (F.col(axis).cast("double") for axis in "xy")
    each = {f"__n{i}": F.count_if(F.col(category) == c) for i, c in enumerate(categories)}
    spots = places.where(finite(x) & finite(y) & F.col(category).isin(categories)).groupBy(x.alias("x"), y.alias("y"))
    spots = spots.agg(*[n.alias(name) for name, n in each.items()])
    names = [(c, r, f"poi_{c}_count_{r * unit:g}m", f"poi_{c}_present_{r * unit:g}m") for c in categories for r in radii]
    straight = (F.size("line") == 2) & F.forall("line", lambda p: finite(p["x"]) & finite(p["y"]))
    found = counts_near_lines(lines.select(key, "line").where(straight), spots, key, list(each), radii)
    bent = lines.select(key, "line").where(F.size("line") > 2)
    if not bent.isEmpty():
        pairs = pairs_within(bent, places.select(category, "x", "y"), max(radii), [key, category])
        counts = [F.count_if((F.col(category) == c) & (F.col("distance") <= r)).alias(f"n_{i}") for i, (c, r, _, _) in enumerate(names)]
        found = found.unionByName(pairs.groupBy(key).agg(*counts))
    found = found.groupBy(key).agg(*[F.sum(f"n_{i}").alias(n) for i, (_, _, n, _) in enumerate(names)])
    out = shuffled_join(lines.select(key), found, key, "left").na.fill(0, [n for _, _, n, _ in names])
    return out.withColumns({p: F.col(n) > 0 for _, _, n, p in names})


#: Locations that a cell may hold where a search starts.
FULL_CELL = 8


def nearest(points_: DataFrame, places: DataFrame, key: str, place: str, cell: float, other: bool = False) -> DataFrame:
    """(key, place, distance) of the nearest place (ties to the smaller place), one row for each row of points (key, x, y).

    With ``other`` a place whose id is the point's own key doesn't count.  Places
    without finite coordinates take no part; points without them, and points for
    which there is no place, get nulls.  Equal locations are looked at once.
    Rings of grid cells start at ``cell`` or so much narrower that no cell holds
    more than ``FULL_CELL`` locations, and grow four times as wide each or as wide
    as the points left are away from all places.  A ring settles the points with
    a place within its width; they grow until every point is settled.  Where
    points are places themselves, few of those that are left share a cell, so
    the pairs looked at grow as the rows do, however dense the places lie.
    """

    def finite(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))

    own = [F.col(key).alias("__k")] if other else []
    asks = points_.where(finite("x") & finite("y")).select(*own, F.col("x").alias("__x"), F.col("y").alias("__y")).distinct()
    nth = F.row_number().over(Window.partitionBy("x", "y").orderBy(place))
    at = places.where(finite("x") & finite("y") & F.col(place).isNotNull()).select(place, "x", "y").distinct()
    at = checkpointed(at.withColumn("__nth", nth).where(F.col("__nth") <= (2 if other else 1)))
    asks = checkpointed(asks)
    names = ["__k", "__x", "__y"] if other else ["__x", "__y"]
    box = at.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")).first()
    distance = F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y"))
    done, left, size = None, asks, cell
    locations = at.where("__nth = 1").select("x", "y")
    at = at.drop("__nth")
    # cells must stay wide enough for their numbers to be exact
    least_size = max([abs(v) for v in box if v is not None], default=0.0) * 2.0**-40
    while box["x1"] is not None and size > least_size:
        fullest = locations.groupBy(*[F.floor(F.col(axis) / size) for axis in "xy"]).count().agg(F.max("count")).first()[0]
        if fullest <= FULL_CELL:
            break
        size /= 2.0 ** max(1, ceil(log2(fullest / FULL_CELL) / 2))
    while box["x1"] is not None:
        gap = F.greatest(box["x1"] - F.col("__x"), F.col("__x") - box["x2"], box["y1"] - F.col("__y"), F.col("__y") - box["y2"], F.lit(0.0))
        rest = left.agg(F.count("*").alias("n"), F.min(gap).alias("least"), F.max(gap).alias("most")).first()
        enough = 2 * (rest["most"] or 0.0) + 2 * (box["x2"] - box["x1"]) + 2 * (box["y2"] - box["y1"]) + cell
        if not rest["n"] or (done is not None and size > 4 * enough):
            break
        size = max(size, rest["least"])

        def of(v: Column, size: float = size) -> Column:
            return F.floor(v / size)

        # cells whose number is too large to be exact wait for a larger size
        around = left.where((F.abs(F.col("__x") / size) < 2.0**52) & (F.abs(F.col("__y") / size) < 2.0**52))
        around = around.withColumn("__cx", F.explode(F.sequence(of(F.col("__x")) - 1, of(F.col("__x")) + 1)))
        around = around.withColumn("__cy", F.explode(F.sequence(of(F.col("__y")) - 1, of(F.col("__y")) + 1)))
        here = at.withColumns({"__cx": of(F.col("x")), "__cy": of(F.col("y"))})
        near = shuffled_join(around, here, ["__cx", "__cy"]).withColumn("distance", distance).where(F.col("distance") <= size)
        if other:
            near = near.where(F.col(place) != F.col("__k"))
        best = near.groupBy(*names).agg(F.min(F.struct("distance", place)).alias("b"))
        sure = checkpointed(best.select(*names, f"b.{place}", "b.distance"))
        done = sure if done is None else done.unionByName(sure)
        left = checkpointed(shuffled_join(left, sure, names, "left_anti"))
        size *= 4
    if done is None:
        return points_.select(key, F.lit(None).cast(places.schema[place].dataType).alias(place), F.lit(None).cast("double").alias("distance"))
    same = (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y"))
    if other:
        same = same & (F.col(key) == F.col("__k"))
    return shuffled_join(points_.select(key, "x", "y"), done, same, "left").select(key, place, "distance")


def route_coverage(pairs: DataFrame, stop_times: DataFrame, trips: DataFrame, key: str) -> DataFrame:
    """Distinct routes that serve the stops paired with each key (key, stop_id)."""
    served = stop_times.select("stop_id", "trip_id").distinct().join(trips.select("trip_id", "route_id"), "trip_id")
    return pairs.join(served.select("stop_id", "route_id").distinct(), "stop_id").groupBy(key).agg(
        F.count_distinct("route_id").alias("n_routes")
    )


def service_frequency(stop_times: DataFrame) -> DataFrame:
    """Mean trips an hour of each stop."""
    return stop_times.groupBy("stop_id").agg((F.count("*") / 24).alias("trips_per_hour"))


def grid_neighbours(df: DataFrame, reach: int) -> DataFrame:
    """df (cx, cy) once for each cell at most ``reach`` cells away in either direction."""
    each = df.withColumn("cx", F.explode(F.sequence(F.col("cx") - reach, F.col("cx") + reach)))
    return each.withColumn("cy", F.explode(F.sequence(F.col("cy") - reach, F.col("cy") + reach)))


def box_gaps(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest distance between a place in box ``a`` and one in box ``b`` (columns a_x1, a_x2, a_y1, a_y2, ...)."""
    least, most = [], []
    for axis in "xy":
        low_a, high_a, low_b, high_b = (F.col(f"{p}_{axis}{i}") for p in (a, b) for i in (1, 2))
        least.append(F.greatest(low_b - high_a, low_a - high_b, F.lit(0.0)))
        most.append(F.greatest(high_b - low_a, high_a - low_b))
    return F.hypot(*least), F.hypot(*most)


def box() -> list[Column]:
    """Aggregates that make the box x1, x2, y1, y2 of a group's places."""
    return [f(axis).alias(f"{axis}{i}") for axis in "xy" for i, f in ((1, F.min), (2, F.max))]


def touching_cells(spots: DataFrame, nodes: DataFrame, eps: float, side: float, direct: int) -> DataFrame:
    """(a, b): labels of the nodes (cx, cy, label, n, box) that have spots (cx, cy, x, y) at most ``eps`` apart.

    Boxes decide most pairs: they are further apart than eps, or nowhere so.  A pair
    that stays open is compared spot by spot if it has at most ``direct`` pairs of
    spots; else both cells are cut into 16 parts, whose boxes are judged likewise,
    and so on.  Every round drops the pairs of cells that are known to touch.
    """
    corners = ["x1", "x2", "y1", "y2"]
    a = nodes.select("cx", "cy", F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("label").alias("a"), F.col("n").alias("a_n"), *[F.col(c).alias(f"a_{c}") for c in corners])
    b = nodes.select("cx", "cy", F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), F.col("label").alias("b"), F.col("n").alias("b_n"), *[F.col(c).alias(f"b_{c}") for c in corners])
    open_pairs = shuffled_join(grid_neighbours(a, 2), b, ["cx", "cy"]).where(F.struct("a_cx", "a_cy") < F.struct("b_cx", "b_cy")).drop("cx", "cy")
    whole = {f"{p}_g{axis}": F.lit(0).cast("long") for p in "ab" for axis in "xy"}
    open_pairs = open_pairs.withColumns(whole)
    least, most = box_gaps("a", "b")
    found, level, width = None, 0, None
    cell, part = ["cx", "cy"], ["gx", "gy"]
    while True:
        judged = checkpointed(open_pairs.where(least <= eps).withColumn("sure", most <= eps))
        here = spots.withColumns({f"g{axis}": F.lit(0).cast("long") if width is None else F.floor(F.col(axis) / width) for axis in "xy"})
        few = judged.where(~F.col("sure") & (F.col("a_n") * F.col("b_n") <= direct))
        sides = []
        for p in "ab":
            sides.append(here.select(*[F.col(c).alias(f"{p}_{c}") for c in cell + part], F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")))
        met = shuffled_join(shuffled_join(few, sides[0], [f"a_{c}" for c in cell + part]), sides[1], [f"b_{c}" for c in cell + part])
        near = met.where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= eps)
        linked = checkpointed(judged.where("sure").select("a", "b").union(near.select("a", "b")).distinct())
        found = linked if found is None else found.union(linked)
        many = shuffled_join(judged.where(~F.col("sure") & (F.col("a_n") * F.col("b_n") > direct)), linked, ["a", "b"], "left_anti")
        if many.isEmpty():
            return found
        level += 1
        width = side / 4.0**level
        inner = spots.withColumns({f"g{axis}": F.floor(F.col(axis) / width) for axis in "xy"})
        outer = {f"o{axis}": F.lit(0).cast("long") if level == 1 else F.floor(F.col(axis) / (side / 4.0 ** (level - 1))) for axis in "xy"}
        wanted = many.select(*[F.col(f"a_{c}").alias(c) for c in cell]).union(many.select(*[F.col(f"b_{c}").alias(c) for c in cell])).distinct()
        parts = shuffled_join(inner, wanted, cell, "left_semi").withColumns(outer).groupBy(*cell, "ox", "oy", *part).agg(F.count("*").alias("n"), *box())
        parts = checkpointed(parts)
        open_pairs = many.select("a", "b", *[f"{p}_{c}" for p in "ab" for c in cell], *[F.col(f"{p}_g{axis}").alias(f"{p}_o{axis}") for p in "ab" for axis in "xy"])
        for p in "ab":
            mine = parts.select(*[F.col(c).alias(f"{p}_{c}") for c in parts.columns])
            open_pairs = shuffled_join(open_pairs, mine, [f"{p}_{c}" for c in cell + ["ox", "oy"]])
        open_pairs = open_pairs.drop(*[f"{p}_o{axis}" for p in "ab" for axis in "xy"])


#: Places of one cell that one task of a pairing meets; cells with more have parts.
CELL_PART = 4096


def density_clusters(df: DataFrame, key: str, eps: float, min_samples: int, max_rounds: int = 40, direct: int = 4096) -> DataFrame:
    """(key, cluster), one row for each of df: DBSCAN on x and y; -1 is noise, clusters are numbered by their smallest key.

    Keys are unique; rows with a null key don't count, and get the cluster of
    their location.  eps is inclusive and min_samples counts the point itself.
    Equal locations are looked at once.  Cells are so small that all their points are neighbours:
    a cell with min_samples points has cores only, so only places of other cells
    count their neighbours, and a cell's cores are one node of the component
    search, whatever their number.  Nodes are connected by smallest labels with
    pointer jumps, each round checkpointed so that plans stay short.  A border
    point goes to the adjacent core of the smallest label.  Points without
    finite coordinates are noise; an empty table has no rows.
    """
    side = eps / sqrt(2) * (1 - 1e-6)

    def finite(name: str) -> Column:
        return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))

    given = df.select(F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    spots = given.where(finite("x") & finite("y") & F.col("k").isNotNull()).groupBy("x", "y").agg(F.count("*").alias("w"), F.min("k").alias("k"))
    spots = spots.withColumns({f"c{axis}": F.floor(F.col(axis) / side) for axis in "xy"})
    sizes = spots.groupBy("cx", "cy").agg(F.sum("w").alias("weight"), F.ceil(F.count("*") / CELL_PART).alias("parts"))
    spots = written(shuffled_join(spots, sizes, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts"))))

    def meetings(asks: DataFrame, others: DataFrame) -> DataFrame:
        """asks with all of the others at most eps away."""
        at = grid_neighbours(asks.select("cx", "cy", F.col("x").alias("x0"), F.col("y").alias("y0")), 2)
        cells = others.groupBy("cx", "cy").agg(F.max("parts").alias("parts"))
        at = shuffled_join(at, cells, ["cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        both = shuffled_join(at, others.select("cx", "cy", "part", "x", "y", "w"), ["cx", "cy", "part"])
        return both.where(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) <= eps)

    full, thin = spots.where(F.col("weight") >= min_samples), spots.where(F.col("weight") < min_samples)
    counts = meetings(thin, spots).groupBy("x0", "y0").agg(F.sum("w").alias("near")).where(F.col("near") >= min_samples)
    cores = written(full.unionByName(shuffled_join(thin, counts.select(F.col("x0").alias("x"), F.col("y0").alias("y")), ["x", "y"], "left_semi")))
    nodes = checkpointed(cores.groupBy("cx", "cy").agg(F.min("k").alias("label"), F.count("*").alias("n"), *box()))
    edges_ = touching_cells(cores.select("cx", "cy", "x", "y"), nodes, eps, side, direct)
    links = checkpointed(edges_.union(edges_.select("b", "a")).toDF("node", "other"))
    labels = nodes.select(F.col("label").alias("node"), "label")
    for _ in range(max_rounds):
        reached = shuffled_join(links, labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("reached"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = shuffled_join(shuffled_join(labels, reached, "node", "left"), jump, "label").select(
            "node", F.least("label", "reached", "far").alias("label"), F.col("label").alias("old")
        )
        new = checkpointed(new)
        done = new.where("label != old").isEmpty()
        labels = new.select("node", "label")
        if done:
            break
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    numbers = with_row_index(labels.select("label").distinct(), ["label"]).select("label", F.col("row").cast("int").alias("cluster"))
    named = shuffled_join(shuffled_join(nodes.select("cx", "cy", F.col("label").alias("node")), labels, "node"), numbers, "label").select("cx", "cy", "cluster")
    edge = meetings(shuffled_join(thin, cores, ["x", "y"], "left_anti"), cores).select("x0", "y0", "cx", "cy").distinct()
    border = shuffled_join(edge, named, ["cx", "cy"]).groupBy(F.col("x0").alias("x"), F.col("y0").alias("y")).agg(F.min("cluster").alias("cluster"))
    placed = shuffled_join(cores, named, ["cx", "cy"]).select("x", "y", "cluster").unionByName(border)
    return shuffled_join(given, placed, ["x", "y"], "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def degree_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar degrees as metres, 111 000 to the degree."""
    return F.hypot(x1 - x2, y1 - y2) * 111000
