"""Land use on a mesh: codes to cells, their areas on the ellipsoid, and the outlines of what cells of one kind cover."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shizuku.operators import spatial

# Half axes of the WGS 84 ellipsoid in metres, and cells in a degree of longitude and latitude of the tenth-part mesh.
MAJOR, MINOR = 6_378_137.0, 6_356_752.314245179
LON_CELLS, LAT_CELLS = 800, 1200


def cell_of(code: Column) -> Column:
    """struct(ix, iy) of a mesh code of ten digits: the cell whose south-west corner is ix / LON_CELLS and iy / LAT_CELLS degrees; null for other texts.

    The digits are two of latitude in two thirds of a degree, two of longitude from 100 degrees on, then pairs (latitude, longitude) of eighths,
    of tenths of these, and of tenths of those.
    """
    d = lambda at, n=1: F.substring(code, at, n).cast("int")
    iy = d(1, 2) * (LAT_CELLS * 2 // 3) + d(5) * 100 + d(7) * 10 + d(9)
    ix = (d(3, 2) + 100) * LON_CELLS + d(6) * 100 + d(8) * 10 + d(10)
    good = code.rlike(r"^\d{4}[0-7]{2}\d{4}$")
    return F.when(good, F.struct(ix.alias("ix"), iy.alias("iy")))


def center(ix: Column, iy: Column) -> tuple[Column, Column]:
    """(lon, lat) of a cell's centre."""
    return (ix + 0.5) / LON_CELLS, (iy + 0.5) / LAT_CELLS


def band_m2(south: Column, north: Column, width: Column) -> Column:
    """Square metres of the ellipsoid between two latitudes over `width` degrees of longitude: the closed form of the integral, no plane is put in between."""
    e = (1 - (MINOR / MAJOR) ** 2) ** 0.5

    def upto(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)

    return F.radians(width) * (MINOR * MINOR / 2) * (upto(north) - upto(south))


def cell_m2(iy: Column) -> Column:
    return band_m2(iy / LAT_CELLS, (iy + 1) / LAT_CELLS, F.lit(1 / LON_CELLS))


def areas(cells: DataFrame, polygons: DataFrame, kind: str = "kind") -> DataFrame:
    """polygon_id, kind, n_cells, m2 of the cells (ix, iy, kind) whose centre lies in a polygon; cells in none have a null polygon_id. A centre in several polygons counts for the smallest id."""
    lon, lat = center(F.col("ix"), F.col("iy"))
    rows = cells.filter("ix IS NOT NULL AND iy IS NOT NULL").select("ix", "iy", kind).withColumns({"lon": lon, "lat": lat})
    found = spatial.point_in_polygon(rows, polygons, single=False).groupBy("lat", "lon").agg(F.min("polygon_id").alias("polygon_id"))
    # Areas hang on the row of the mesh alone: cells are counted by row first.
    counts = rows.join(found, ["lat", "lon"], "left").groupBy("polygon_id", kind, "iy").agg(F.count("*").alias("n"))
    return counts.groupBy("polygon_id", kind).agg(F.sum("n").alias("n_cells"), F.sum(F.col("n") * cell_m2(F.col("iy"))).alias("m2"))


def borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x1, y1, x2, y2: the sides of cells (ix, iy) that no other cell of equal keys shares, with the cell on their left.

    A side that two cells share is walked once in each direction: the directions add up to nothing, before the shuffle where both cells lie in one
    task. Repeated cells count once.
    """
    x, y = F.col("ix"), F.col("iy")
    side = lambda x1, y1, x2, y2, sign: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(sign).alias("sign"))
    # Each side from its smaller end; sign -1: walked from the other.
    sides = F.array(side(x, y, x + 1, y, 1), side(x + 1, y, x + 1, y + 1, 1), side(x, y + 1, x + 1, y + 1, -1), side(x, y, x, y + 1, -1))
    listed = cells.filter("ix IS NOT NULL AND iy IS NOT NULL").select(*keys, "ix", "iy").distinct().select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    left = listed.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    turn = lambda a, b: F.when(F.col("sign") > 0, F.col(a)).otherwise(F.col(b))
    return left.select(*keys, turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))


def rings_of(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed sides, without the corners on straight lines, each from its smallest corner. Outer rings run against the clock, holes with it; where four sides meet, rings turn left, so cells that touch at a corner only are parted."""
    onward: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for x1, y1, x2, y2 in sides:
        onward[x1, y1].append((x2, y2))
    out = []
    for start in sorted(onward):
        while onward[start]:
            ring, at = [start], onward[start].pop()
            before = start
            while at != start:
                ring.append(at)
                ways = onward[at]
                dx, dy = at[0] - before[0], at[1] - before[1]
                # Left first: the way with the greatest cross product.
                k = max(range(len(ways)), key=lambda i: dx * (ways[i][1] - at[1]) - dy * (ways[i][0] - at[0]))
                before, at = at, ways.pop(k)
            corners = [q for p, q, r in zip([ring[-1], *ring], ring, [*ring[1:], ring[0]], strict=False) if (q[0] - p[0]) * (r[1] - q[1]) != (q[1] - p[1]) * (r[0] - q[0])]
            first = corners.index(min(corners))
            out.append(corners[first:] + corners[:first])
    return out


def outlines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring (from 0), hole, corners array of (x, y) of what the cells of equal keys cover together. A task holds the outline of one key, not its cells."""
    schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys) + ", ring int, hole boolean, corners array<struct<x:int,y:int>>"

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = rings_of(list(pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)))
        twice = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) for r in rings]
        rows = [{**{k: pdf[k].iloc[0] for k in keys}, "ring": i, "hole": t < 0, "corners": [{"x": x, "y": y} for x, y in r]} for i, (r, t) in enumerate(zip(rings, twice, strict=True))]
        return pd.DataFrame(rows, columns=[*keys, "ring", "hole", "corners"])

    return borders(cells, keys).groupBy(*keys).applyInPandas(stitched, schema)
