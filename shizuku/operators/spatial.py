"""Points in polygons and nearest places, as equi-joins over grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shizuku.functions import naming
from shizuku.sources.stored import checkpoints

#: Distance to an edge, in degrees, below which a point is judged with exact arithmetic.
CLOSE = 1e-9
#: Degrees of the sides of cells, each a quarter of the one before; edges that a cell keeps; where in a cell its reference point lies, off the places where edges are drawn.
SIDES, EDGES, REFERENCE = tuple(64.0 / 4**k for k in range(9)), 16, (0.41421356237309503, 0.61803398874989485)
HALF_ROUND_KM = 20_040.0


def _exact(x: float, y: float, ring: list) -> bool:
    """Even-odd rule in rational numbers. A point on an edge has no side and is an error."""
    px, py, inside = Fraction(x), Fraction(y), False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b, c, d = Fraction(x1), Fraction(y1), Fraction(x2), Fraction(y2)
        cross = (c - a) * (py - b) - (d - b) * (px - a)
        if cross == 0 and min(a, c) <= px <= max(a, c) and min(b, d) <= py <= max(b, d):
            raise ValueError(f"({x}, {y}) lies on an edge")
        if (b > py) != (d > py) and px < a + (py - b) * (c - a) / (d - b):
            inside = not inside
    return inside


def contains(xs: np.ndarray, ys: np.ndarray, rings: list) -> np.ndarray:
    """Whether points lie inside a polygon with holes, even-odd over all its rings; close calls are made exactly."""
    inside, close = np.zeros(len(xs), bool), np.zeros(len(xs), bool)
    for ring in rings:
        p = np.asarray([tuple(q) for q in ring], float)
        q = np.roll(p, -1, 0)
        for (x1, y1), (x2, y2) in zip(p, q, strict=True):
            spans = (y1 > ys) != (y2 > ys)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = x1 + (ys - y1) * (x2 - x1) / (y2 - y1)
            inside ^= spans & (xs < at)
            length = np.hypot(x2 - x1, y2 - y1)
            away = np.abs((x2 - x1) * (ys - y1) - (y2 - y1) * (xs - x1)) / max(length, 1e-300)
            near = (xs >= min(x1, x2) - CLOSE) & (xs <= max(x1, x2) + CLOSE) & (ys >= min(y1, y2) - CLOSE) & (ys <= max(y1, y2) + CLOSE)
            close |= near & (away <= CLOSE)
    for i in np.flatnonzero(close):
        inside[i] = sum(_exact(float(xs[i]), float(ys[i]), [tuple(map(float, q)) for q in ring]) for ring in rings) % 2 == 1
    return inside


# Covers.


def _path(edges: np.ndarray, ax: float, ay: float, bx: float, by: float) -> tuple[bool, bool]:
    """Whether the path from a along x = ax to b's height, then along y = by to b, crosses the edges an odd number of times; and whether that is too close to tell."""
    x1, y1, x2, y2 = edges.T
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        up, across = (x1 > ax) != (x2 > ax), (y1 > by) != (y2 > by)
        at_y, at_x = y1 + (ax - x1) * (y2 - y1) / (x2 - x1), x1 + (by - y1) * (x2 - x1) / (y2 - y1)
    odd = np.count_nonzero(up & ((at_y > ay) != (at_y > by))) + np.count_nonzero(across & ((at_x > ax) != (at_x > bx)))
    length = np.maximum(np.hypot(x2 - x1, y2 - y1), 1e-300)
    close = False
    for px, py in ((ax, ay), (ax, by), (bx, by)):
        away = np.abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) / length
        near = (px >= np.minimum(x1, x2) - CLOSE) & (px <= np.maximum(x1, x2) + CLOSE) & (py >= np.minimum(y1, y2) - CLOSE) & (py <= np.maximum(y1, y2) + CLOSE)
        close |= bool((near & (away <= CLOSE)).any())
    return odd % 2 == 1, close


def _exact_path(edges: list, ax: float, ay: float, bx: float, by: float, strict: bool = True) -> bool | None:
    """The same in rational numbers. Where the path's corner lies on an edge, it takes the other corner. b on an edge is an error, or None if not `strict`."""
    ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
    lines = [tuple(map(Fraction, e)) for e in edges]

    def on(px: Fraction, py: Fraction) -> bool:
        return any((c - a) * (py - b) == (d - b) * (px - a) and min(a, c) <= px <= max(a, c) and min(b, d) <= py <= max(b, d) for a, b, c, d in lines)

    def upright(x: Fraction, lo: Fraction, hi: Fraction) -> int:
        hits = [b + (x - a) * (d - b) / (c - a) for a, b, c, d in lines if (a > x) != (c > x)]
        return sum((h > lo) != (h > hi) for h in hits)

    def level(y: Fraction, lo: Fraction, hi: Fraction) -> int:
        hits = [a + (y - b) * (c - a) / (d - b) for a, b, c, d in lines if (b > y) != (d > y)]
        return sum((h > lo) != (h > hi) for h in hits)

    if on(bx, by):
        if not strict:
            return None
        raise ValueError(f"({float(bx)}, {float(by)}) lies on an edge")
    if not on(ax, by):
        return (upright(ax, ay, by) + level(by, ax, bx)) % 2 == 1
    if not on(bx, ay):
        return (level(ay, ax, bx) + upright(bx, ay, by)) % 2 == 1
    raise ValueError(f"({float(bx)}, {float(by)}) can't be told from its cell")


def _crosses(edges: np.ndarray, ax: float, ay: float, bx: float, by: float) -> bool:
    odd, close = _path(edges, ax, ay, bx, by)
    return _exact_path(edges.tolist(), ax, ay, bx, by) if close else odd


def cover(rings: list, most: int = EDGES) -> Iterator[tuple]:
    """level, cx, cy, inside, edges of the cells that a polygon with holes and parts covers, even-odd over all its rings.

    Cells are squares of SIDES[level] degrees; those that more than `most` edges touch are divided into sixteen, down to the last level. A
    cell without edges lies inside as a whole and needs no test (cells outside aren't listed). One with edges comes with them and with whether its
    reference point lies inside: another of its points does if the way there crosses an even number of these edges.
    """
    parts = [np.asarray([tuple(q)[:2] for q in ring], float) for ring in rings if len(ring)]
    edges = np.concatenate([np.hstack([p, np.roll(p, -1, 0)]) for p in parts]) if parts else np.zeros((0, 4))
    edges = edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]
    if not len(edges):
        return
    lo, hi = edges.reshape(-1, 2).min(0), edges.reshape(-1, 2).max(0)
    level = max((k for k, side in enumerate(SIDES) if side >= (hi - lo).max()), default=0)
    side, outside = SIDES[level], (lo[0] - 1.0, lo[1] - 1.0)
    first, last = np.floor(lo / side).astype(int), np.floor(hi / side).astype(int)
    stack = []
    for cx in range(first[0], last[0] + 1):
        for cy in range(first[1], last[1] + 1):
            x, y = (cx + REFERENCE[0]) * side, (cy + REFERENCE[1]) * side
            stack.append((level, cx, cy, edges[_touches(edges, cx * side, cy * side, side)], _crosses(edges, *outside, x, y)))
    while stack:
        level, cx, cy, own, inside = stack.pop()
        if not len(own):
            if inside:
                yield level, cx, cy, True, None
            continue
        if len(own) <= most or level == len(SIDES) - 1:
            yield level, cx, cy, inside, own
            continue
        side, small = SIDES[level], SIDES[level + 1]
        x, y = (cx + REFERENCE[0]) * side, (cy + REFERENCE[1]) * side
        for i in range(4 * cx, 4 * cx + 4):
            for j in range(4 * cy, 4 * cy + 4):
                there = (i + REFERENCE[0]) * small, (j + REFERENCE[1]) * small
                stack.append((level + 1, i, j, own[_touches(own, i * small, j * small, small)], inside ^ _crosses(own, x, y, *there)))


def _touches(edges: np.ndarray, x: float, y: float, side: float) -> np.ndarray:
    """Which edges may touch a closed square: their bounds overlap it, and its corners don't all lie on one side of their line."""
    x1, y1, x2, y2 = edges.T
    bounds = (np.minimum(x1, x2) <= x + side) & (np.maximum(x1, x2) >= x) & (np.minimum(y1, y2) <= y + side) & (np.maximum(y1, y2) >= y)
    corners = np.array([(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (x, x + side) for cy in (y, y + side)])
    slack = 1e-12 * (1 + np.abs(edges).max(1)) * np.maximum(np.hypot(x2 - x1, y2 - y1), 1e-300)
    return bounds & (corners.min(0) <= slack) & (corners.max(0) >= -slack)


def covers(polygons: DataFrame, most: int = EDGES) -> DataFrame:
    """polygon_id, level, cx, cy, inside, edges (null where the whole cell lies inside) of all polygons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.struct([(n, pa.float64()) for n in ("x1", "y1", "x2", "y2")])
        for batch in batches:
            for key, rings in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cells = cover(rings or [], most)
                while chunk := list(islice(cells, 5000)):
                    lists = [None if e is None else [dict(zip(("x1", "y1", "x2", "y2"), q, strict=True)) for q in e.tolist()] for *_, e in chunk]
                    columns = [pa.array([key.as_py()] * len(chunk), key.type), *(pa.array([int(c[i]) for c in chunk], pa.int64() if i else pa.int32()) for i in range(3)), pa.array([bool(c[3]) for c in chunk]), pa.array(lists, pa.list_(line))]
                    yield pa.RecordBatch.from_arrays(columns, names=["polygon_id", "level", "cx", "cy", "inside", "edges"])

    kind = polygons.schema["polygon_id"].dataType.simpleString()
    return polygons.select("polygon_id", "rings").mapInArrow(run, f"polygon_id {kind}, level int, cx long, cy long, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def point_in_polygon(points: DataFrame, polygons: DataFrame, single: bool = True, most: int = EDGES, strict: bool = True) -> DataFrame:
    """lat, lon, polygon_id for each distinct point within a polygon. polygons: polygon_id, rings array<array<array<double>>> of (lon, lat).

    Polygons are listed by the cells of their covers, coarse ones inside, fine ones along their edges, so the list grows with their outlines. Distinct points
    join by cell, once for each size of cell there is. In a cell that edges touch a point is compared with the cell's reference point over
    these few edges, in compiled expressions; close calls are made exactly, in Python. A point on an edge is an error, and so is, with
    `single`, one in two polygons. Without `strict` each ring counts without its edges: a point on the edge of a polygon lies outside of it, one on the
    edge of a hole within the polygon around it. A point then lies in a polygon if an odd number of its rings hold it.
    """
    if strict:
        found = _found(points, polygons, most, True)
    else:
        rings = polygons.select("polygon_id", F.posexplode("rings").alias("ring", "points")).select(F.struct("polygon_id", "ring").alias("polygon_id"), F.array("points").alias("rings"))
        held = _found(points, rings, most, False).groupBy("lat", "lon", F.col("polygon_id.polygon_id").alias("polygon_id")).agg(F.count("*").alias("n"))
        found = held.filter("n % 2 = 1").drop("n")
    if not single:
        return found
    n = F.count("*").over(Window.partitionBy("lat", "lon"))
    return found.withColumn("n", n).withColumn("polygon_id", F.when(F.col("n") == 1, F.col("polygon_id")).otherwise(F.raise_error(F.lit("a point lies in two polygons")))).drop("n")


def _found(points: DataFrame, polygons: DataFrame, most: int, strict: bool) -> DataFrame:
    """lat, lon, polygon_id for each distinct point within a polygon; one on an edge is an error, or outside if not `strict`."""
    checkpoints(points.sparkSession)
    cells = covers(polygons, most).checkpoint()
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # as many as SIDES at most
    distinct = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct()
    sides = [F.struct(F.lit(k).alias("level"), F.floor(F.col("lon") / SIDES[k]).alias("cx"), F.floor(F.col("lat") / SIDES[k]).alias("cy")) for k in levels]
    at = distinct.withColumn("c", F.explode(F.array(*sides) if sides else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>"))).select("lat", "lon", "c.*")
    pairs = at.join(cells, ["level", "cx", "cy"])
    size = F.element_at(F.array(*map(F.lit, SIDES)), F.col("level") + 1)
    pairs = pairs.select("lat", "lon", "polygon_id", "inside", "edges", ((F.col("cx") + REFERENCE[0]) * size).alias("rx"), ((F.col("cy") + REFERENCE[1]) * size).alias("ry"))

    def crossed(e: Column) -> Column:
        rx, ry, x, y = (F.col(c) for c in ("rx", "ry", "lon", "lat"))
        at_y, at_x = e["y1"] + (rx - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"]), e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        up = F.when((e["x1"] > rx) != (e["x2"] > rx), (at_y > ry) != (at_y > y)).otherwise(False)
        return up != F.when((e["y1"] > y) != (e["y2"] > y), (at_x > rx) != (at_x > x)).otherwise(False)

    def close(e: Column) -> Column:
        def near(px: Column) -> Column:
            dx, dy, py = e["x2"] - e["x1"], e["y2"] - e["y1"], F.col("lat")
            bounds = px.between(F.least(e["x1"], e["x2"]) - CLOSE, F.greatest(e["x1"], e["x2"]) + CLOSE) & py.between(F.least(e["y1"], e["y2"]) - CLOSE, F.greatest(e["y1"], e["y2"]) + CLOSE)
            return bounds & (F.abs(dx * (py - e["y1"]) - dy * (px - e["x1"])) <= CLOSE * F.sqrt(dx * dx + dy * dy))

        return near(F.col("lon")) | near(F.col("rx"))

    @F.pandas_udf("boolean")
    def exactly(lon: pd.Series, lat: pd.Series, rx: pd.Series, ry: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([_exact_path([tuple(q[k] for k in ("x1", "y1", "x2", "y2")) for q in e], a, b, x, y, strict) for x, y, a, b, e in zip(lon, lat, rx, ry, edges, strict=True)], dtype=object)

    whole = pairs.filter("edges IS NULL")
    cut = pairs.filter("edges IS NOT NULL").withColumn("close", F.exists("edges", close))
    odd = F.aggregate("edges", F.lit(False), lambda so_far, e: so_far != crossed(e))
    clear = cut.filter(~F.col("close")).filter(F.col("inside") != odd)
    judged = cut.filter("close").withColumn("odd", exactly("lon", "lat", "rx", "ry", "edges")).filter(F.col("inside") != F.col("odd"))
    return reduce(DataFrame.unionByName, (x.select("lat", "lon", "polygon_id") for x in (whole, clear, judged)))


# Nearest places.


def nearest(points: DataFrame, places: DataFrame, reach_km: float) -> DataFrame:
    """point_id, place_id, km of the nearest place within reach; ties go to the smaller place id."""
    return _answers(points, _within(points.select("lat", "lon").distinct(), places, reach_km))


def _answers(points: DataFrame, found: DataFrame) -> DataFrame:
    best = points.join(found, ["lat", "lon"]).groupBy("point_id").agg(F.min("b").alias("b"))
    return best.select("point_id", "b.place_id", "b.km")


def nearest_any(points: DataFrame, places: DataFrame, first_km: float = 50.0, wider: float = 4.0) -> DataFrame:
    """point_id, place_id, km of the nearest place, however far; ties go to the smaller place id. Without places there are no rows; points without coordinates have none.

    Rounds: what a reach finds is the nearest there is, so only coordinates without any place in reach go on to a reach `wider` times as
    long, until that is half of the globe. Most points are settled in the first round, over small cells.
    """
    checkpoints(points.sparkSession)
    rest = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct().checkpoint()
    there = places.filter("lat IS NOT NULL AND lon IS NOT NULL")
    settled, reach = [], first_km
    while not settled or (reach < wider * HALF_ROUND_KM and not rest.isEmpty()):
        settled.append(_within(rest, there, min(reach, HALF_ROUND_KM)).checkpoint())
        rest = rest.join(settled[-1], ["lat", "lon"], "left_anti").checkpoint()
        reach *= wider
    return _answers(points, reduce(DataFrame.unionByName, settled))


def _within(coordinates: DataFrame, places: DataFrame, reach_km: float) -> DataFrame:
    """lat, lon, b (km, place_id) of the nearest place within reach.

    Both sides are dealt to cells as wide as the reach, places to their neighbouring cells too, so that only neighbours meet.
    Each distinct coordinate is searched once: places at one coordinate fold to their smallest id, points get their coordinate's answer.
    """
    side = min(reach_km / 111.0, 90.0)
    around = math.ceil(360.0 / side)  # cells of a circle of latitude; the last may be narrower than the rest
    cx = lambda: F.pmod(F.floor((F.col("lon") + 180.0) / side), F.lit(around))
    cy = lambda: F.floor(F.col("lat") / side)
    # Degrees of longitude that the reach spans at the latitude furthest from the equator; near a pole, all.
    far = F.abs("lat") + 1.01 * side
    span = F.when(far >= 89.9, 360.0).otherwise(side / F.cos(F.radians(far)))
    steps = F.least(F.ceil(span / side).cast("int") + 1, F.lit(around // 2 + 1))
    p = coordinates.withColumn("cx", cx()).withColumn("cy", cy())
    q = places.groupBy("lat", "lon").agg(F.min("place_id").alias("place_id")).select(F.col("place_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), cx().alias("ox"), cy().alias("oy"), steps.alias("steps"))
    q = q.withColumn("dx", F.explode(F.sequence(-F.col("steps"), F.col("steps")))).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    q = q.withColumn("cx", F.pmod(F.col("ox") + F.col("dx"), F.lit(around))).withColumn("cy", F.col("oy") + F.col("dy"))
    pairs = p.join(q, ["cx", "cy"]).withColumn("km", naming.haversine_km(F.col("lat"), F.col("lon"), F.col("q_lat"), F.col("q_lon"))).filter(F.col("km") <= reach_km)
    return pairs.groupBy("lat", "lon").agg(F.min(F.struct("km", "place_id")).alias("b"))
