"""Meshes: codes, areas of the ellipsoid, outlines with holes and parts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shizuku.operators import mesh


@pytest.mark.parametrize(("code", "lon", "lat"), [("5339463611", 139 + 6 / 8 + 6 / 80 + 1 / 800, 53 / 1.5 + 4 / 12 + 3 / 120 + 1 / 1200), ("5339000000", 139.0, 53 / 1.5), ("6848779999", 148 + 7 / 8 + 9 / 80 + 9 / 800, 68 / 1.5 + 7 / 12 + 9 / 120 + 9 / 1200)])
def test_codes(spark, code, lon, lat):
    c = spark.createDataFrame([(code,)], "c string").select(mesh.cell_of(F.col("c")).alias("c")).first()["c"]
    assert c["ix"] / mesh.LON_CELLS == pytest.approx(lon, abs=1e-12) and c["iy"] / mesh.LAT_CELLS == pytest.approx(lat, abs=1e-12)


def test_odd_codes(spark):
    rows = spark.createDataFrame([(None,), ("",), ("533946361",), ("53394636110",), ("5339863611",), ("53394636a1",)], "c string")
    assert {r["c"] for r in rows.select(mesh.cell_of(F.col("c")).alias("c")).collect()} == {None}


def test_areas_of_the_ellipsoid(spark):
    area = lambda s, n, w: spark.range(1).select(mesh.band_m2(F.lit(s), F.lit(n), F.lit(w)).alias("a")).first()["a"]
    assert area(-90.0, 90.0, 360.0) == pytest.approx(510_065_621_724_088.4, rel=1e-9)  # the whole surface
    assert area(0.0, 45.0, 1.0) + area(45.0, 90.0, 1.0) == pytest.approx(area(0.0, 90.0, 1.0), rel=1e-12)
    e2, a = 1 - (mesh.MINOR / mesh.MAJOR) ** 2, mesh.MAJOR
    steps = [35 + (k + 0.5) / 1000 for k in range(1000)]  # the integral of the radii of curvature, by the midpoint rule
    whole = sum(a * a * (1 - e2) * math.cos(math.radians(x)) / (1 - e2 * math.sin(math.radians(x)) ** 2) ** 2 for x in steps) * math.radians(1 / 1000) * math.radians(1.0)
    assert area(35.0, 36.0, 1.0) == pytest.approx(whole, rel=1e-8)


def test_outlines_with_holes_and_corners(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    cells = [("ring", *c) for c in [*ring, ring[0]]] + [("corner", 0, 0), ("corner", 1, 1), ("bar", 5, 5), ("bar", 6, 5), ("bar", 7, 5), ("bar", None, 1), (None, 2, 2)]
    got = {(r.k, r.hole): [tuple(c) for c in r.corners] for r in mesh.outlines(spark.createDataFrame(cells, "k string, ix int, iy int"), ["k"]).filter("k <> 'corner' OR k IS NULL").collect()}
    assert got == {("ring", False): [(0, 0), (3, 0), (3, 3), (0, 3)], ("ring", True): [(1, 1), (1, 2), (2, 2), (2, 1)], ("bar", False): [(5, 5), (8, 5), (8, 6), (5, 6)], (None, False): [(2, 2), (3, 2), (3, 3), (2, 3)]}
    corner = mesh.outlines(spark.createDataFrame(cells, "k string, ix int, iy int"), ["k"]).filter("k = 'corner'").collect()
    assert sorted([tuple(c) for c in r.corners] for r in corner) == [[(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]
    assert mesh.outlines(spark.createDataFrame([], "k string, ix int, iy int"), ["k"]).count() == 0


def test_rings_of_random_cells():
    draw = random.Random(7)
    for _ in range(60):
        cells = {(draw.randrange(7), draw.randrange(7)) for _ in range(draw.randrange(1, 40))}
        sides = [s for x, y in cells for s, other in (((x, y, x + 1, y), (x, y - 1)), ((x + 1, y, x + 1, y + 1), (x + 1, y)), ((x + 1, y + 1, x, y + 1), (x, y + 1)), ((x, y + 1, x, y), (x - 1, y))) if other not in cells]
        rings = mesh.rings_of(sides)
        twice = sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True))
        assert twice == 2 * len(cells) and sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)) == len(sides)
        for x in range(-1, 8):  # even-odd over all rings: inside are the cells
            for y in range(-1, 8):
                crossed = sum((a[1] > y + 0.5) != (b[1] > y + 0.5) and a[0] > x + 0.5 for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True))
                assert (crossed % 2 == 1) == ((x, y) in cells)
