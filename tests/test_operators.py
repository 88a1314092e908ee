import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shizuku import registered
from shizuku.operators import documents, flow, registry, sampling, spatial, tables, terrain
from shizuku.plans import envelope
from shizuku.sources import files
from shizuku.sources import tables as store


def polygons(spark, rows):
    return spark.createDataFrame(rows, "polygon_id string, rings array<array<array<double>>>")


SQUARE = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
HOLE = [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6]]


def test_points_in_polygons(spark):
    far = [[x + 5, y] for x, y in SQUARE]
    points = spark.createDataFrame([(0.2, 0.3), (0.2, 0.3), (0.5, 0.5), (0.5, 5.5), (9.0, 9.0), (None, 1.0)], "lat double, lon double")
    got = {(r.lat, r.lon, r.polygon_id) for r in spatial.point_in_polygon(points, polygons(spark, [("a", [SQUARE, HOLE]), ("b", [far])])).collect()}
    assert got == {(0.2, 0.3, "a"), (0.5, 5.5, "b")}


@pytest.mark.parametrize("point", [(0.0, 0.5), (1.0, 1.0), (0.5, 0.4)])
def test_points_on_edges_are_errors(spark, point):
    with pytest.raises(Exception, match="edge"):
        spatial.point_in_polygon(spark.createDataFrame([point], "lat double, lon double"), polygons(spark, [("a", [SQUARE, HOLE])])).collect()


def test_points_on_edges_without_strictness(spark):
    """Each ring without its edges: outside of the polygon on its edge, within it on its hole's, in neither of two neighbours between them."""
    beside = [[x + 1, y] for x, y in SQUARE]
    shapes = polygons(spark, [("a", [SQUARE, HOLE]), ("b", [beside]), ("none", None)])
    points = [(0.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.5, 0.4), (0.4, 0.4), (0.5, 0.5), (0.2, 0.3), (0.5, 1.5), (0.5, 2.0), (0.6, 0.4 + 2**-50), (None, 0.5)]
    got = {tuple(r) for r in spatial.point_in_polygon(spark.createDataFrame(points, "lat double, lon double"), shapes, strict=False).collect()}
    assert got == {(0.5, 0.4, "a"), (0.4, 0.4, "a"), (0.2, 0.3, "a"), (0.5, 1.5, "b"), (0.6, 0.4 + 2**-50, "a")}
    with pytest.raises(Exception, match="two polygons"):
        spatial.point_in_polygon(spark.createDataFrame([(0.2, 0.2)], "lat double, lon double"), polygons(spark, [("a", [SQUARE]), ("b", [SQUARE])]), strict=False).collect()


def test_customers_on_edges_count_as_in_the_sql(spark, tmp_path):
    import duckdb

    rows = [(5, 2999.5), (50, 2999.5), (15, 999.5), (12, 1999.5), (7, -0.5), (60, 6999.5), (3, 500.0), (15, 1500.0), (33, 4000.0), (41, None)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    sql = registered.SQL["pip_grid_join"].replace("customer", f"'{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(duckdb.sql(sql).fetchall())
    assert sorted(map(tuple, registered.QUERIES["pip_grid_join"](spark, f"file://{tmp_path}").select("polygon_id", "n").collect())) == want == [("a", 3), ("b", 1), ("c", 1)]


def test_overlapping_polygons_are_errors(spark):
    with pytest.raises(Exception, match="two polygons"):
        spatial.point_in_polygon(spark.createDataFrame([(0.2, 0.2)], "lat double, lon double"), polygons(spark, [("a", [SQUARE]), ("b", [SQUARE])])).collect()


def test_random_points_match_the_exact_rule(spark):
    rng = np.random.default_rng(1)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 25))
    ring = [[float(r * np.cos(t)), float(r * np.sin(t))] for t, r in zip(angle, rng.uniform(0.3, 1, 25), strict=True)]
    xs, ys = rng.uniform(-1, 1, 300), rng.uniform(-1, 1, 300)
    assert spatial.contains(xs, ys, [ring]).tolist() == [spatial._exact(float(x), float(y), [tuple(p) for p in ring]) for x, y in zip(xs, ys, strict=True)]


def star(rng, n, cx=0.0, cy=0.0, r=1.0):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    return [[float(cx + q * np.cos(t)), float(cy + q * np.sin(t))] for t, q in zip(angle, r * rng.uniform(0.3, 1, n), strict=True)]


def test_covers_of_random_polygons_match_the_exact_rule(spark):
    rng = np.random.default_rng(4)
    shapes = [("small", [star(rng, 9, 1, 1, 0.01)]), ("parts", [star(rng, 40, -3, 2), star(rng, 5, -3, 2, 0.2), star(rng, 60, 40, -20, 3)]), ("many", [star(rng, 3000, 100, 50, 10)]), ("world", [[[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0]], star(rng, 30, 5, 5, 4)]), ("empty", []), ("none", None)]
    points = [(float(y), float(x)) for cx, cy, r in ((1, 1, 0.012), (-3, 2, 1.1), (40, -20, 3), (100, 50, 10.5), (5, 5, 5)) for x, y in zip(rng.uniform(cx - r, cx + r, 80), rng.uniform(cy - r, cy + r, 80), strict=True)]
    points += [(float(round(y * 64) / 64), float(round(x * 64) / 64)) for y, x in points[:160]]  # on the borders of cells
    got = {tuple(r) for r in spatial.point_in_polygon(spark.createDataFrame(points, "lat double, lon double"), polygons(spark, shapes), single=False).collect()}
    want = {(y, x, name) for name, rings in shapes for y, x in points if sum(spatial._exact(x, y, [tuple(p) for p in ring]) for ring in rings or []) % 2}
    assert got == want
    cells = spatial.covers(polygons(spark, shapes)).groupBy("polygon_id").agg(F.count("*").alias("n"), F.max(F.size("edges")).alias("e"), F.count_if(F.col("edges").isNull()).alias("whole")).collect()
    by = {r.polygon_id: r for r in cells}
    assert set(by) == {"small", "parts", "many", "world"} and by["world"].n < 400 and by["many"].n < 4 * 3000 and by["many"].whole > 10 and all(r.e <= spatial.EDGES for r in cells)


def test_points_near_edges_are_judged_exactly(spark):
    ring = [[0.0, 0.0], [1.0, 0.1], [1.1, 1.0], [0.1, 0.9]]
    on = [(0.05, 0.5), (0.05 + 2**-50, 0.5), (0.05 - 2**-50, 0.5)]
    frame = lambda rows: spark.createDataFrame(rows, "lat double, lon double")
    for lat, lon in on:
        try:
            want = {(lat, lon)} if spatial._exact(lon, lat, [tuple(p) for p in ring]) else set()
        except ValueError:
            with pytest.raises(Exception, match="edge"):
                spatial.point_in_polygon(frame([(lat, lon)]), polygons(spark, [("a", [ring])])).collect()
            continue
        assert {(r.lat, r.lon) for r in spatial.point_in_polygon(frame([(lat, lon)]), polygons(spark, [("a", [ring])])).collect()} == want


def test_nearest_without_a_reach(spark):
    rng = np.random.default_rng(8)
    points = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(150)] + [(150, None, 1.0), (151, -3.0, 12.0), (152, 90.0, 0.0)]
    places = [(f"p{i}", float(rng.uniform(-8, 8)), float(rng.uniform(-5, 25))) for i in range(20)] + [("p99", -3.0, 12.0), ("p98", -3.0, 12.0)]
    km = lambda a, b: 2 * 6371.0088 * np.arcsin(min(1.0, np.sqrt(np.sin(np.radians(b[0] - a[0]) / 2) ** 2 + np.cos(np.radians(a[0])) * np.cos(np.radians(b[0])) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2)))
    want = {k: min((round(km((lat, lon), p[1:]), 6), p[0]) for p in places)[1] for k, lat, lon in points if lat is not None}
    df, to = spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(places, "place_id string, lat double, lon double")
    assert {r.point_id: r.place_id for r in spatial.nearest_any(df, to).collect()} == want
    assert spatial.nearest_any(df, to.limit(0)).count() == 0 and spatial.nearest_any(df.limit(0), to).count() == 0


def test_nearest(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 10.0), (3, -45.0, 100.0)], "point_id int, lat double, lon double")
    places = spark.createDataFrame([("b", 0.0, 0.1), ("a", 0.0, -0.1), ("c", 60.0, 10.15), ("d", 60.2, 10.0)], "place_id string, lat double, lon double")
    assert {(r.point_id, r.place_id) for r in spatial.nearest(points, places, 30.0).collect()} == {(1, "a"), (2, "c")}


def test_nearest_of_shared_coordinates_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    points = [(int(i % 350), float(rng.integers(0, 12)) / 7, float(rng.integers(0, 12)) / 7) for i in range(400)]
    places = [(f"p{i}", float(rng.integers(0, 6)) / 3, float(rng.integers(0, 6)) / 3) for i in range(60)]
    want = {}
    for point, lat, lon in points:
        for place, y, x in places:
            a, b, c, d = map(np.radians, (lat, lon, y, x))
            km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))
            if km <= 20:
                want[point] = min(want.get(point, (1e9, "")), (round(km, 6), place))
    got = spatial.nearest(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(places, "place_id string, lat double, lon double"), 20.0).collect()
    assert {r.point_id: (round(r.km, 6), r.place_id) for r in got} == want and len(got) == len(want) and 0 < len(want) < 350


def test_features_and_differences_of_whole_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    customers = {r.c_custkey: r.c_acctbal for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal").collect()}
    ordering = {r.o_custkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").collect()}
    features = registered.QUERIES["mesh_features"](spark, sf_dir).collect()
    assert sorted((r.id, r.gx, r.gy, r.corners) for r in features) == sorted((k, int(v // 100), k % 100, 5) for k, v in customers.items())
    credit = {k for k, v in customers.items() if v > 0}
    got = sorted((r.c_custkey, r.side) for r in registered.QUERIES["declared_difference_all"](spark, sf_dir).collect())
    assert got == sorted([(k, "missing") for k in credit - ordering] + [(k, "stale") for k in ordering - credit])
    assert {side for _, side in got} <= {"missing", "stale"} and got


def test_nearest_place_of_every_customer(spark):
    sf_dir = "/root/testdata/sf0.01"
    customers = [r.c_custkey for r in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").collect()]
    at = lambda k, m, n: np.radians(((k % m) / n))
    s = np.array([r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect()])
    want = {}
    for k in customers:
        a, b, c, d = at(k, 40, 10.0), at(k, 37, 10.0), at(s, 17, 4.0), at(s, 13, 3.0)
        km = (2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))).min()
        if km <= 50:
            want[k] = km
    got = {r.point_id: r.km for r in registered.QUERIES["nearest_place"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and max(got) > 500
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


EDGE = "to_id string, from_id string, share double, basis string, valid_from string, valid_to string"
ASSIGN = "zone string, facility_id string, share double, confidence string, valid_from string, valid_to string"


def test_flow(spark):
    edges = [("f1", "s1", 0.7, "measured", None, None), ("f1", "s2", 0.3, "derived", None, None), ("f2", "f1", 0.5, "published", None, None), ("f2", "gone", 0.5, "measured", None, None), ("f3", "s1", None, "unknown", None, None), ("f3", "s2", 0.5, "measured", None, None), ("f4", "f5", 1.0, "measured", None, None), ("f5", "f4", 1.0, "measured", None, None), ("f1", "s9", 1.0, "measured", "2000-01-01", "2020-01-01")]
    zones = [("z1", "f1", 1.0, "high", None, None), ("z2", "f2", 1.0, "low", None, None), ("z3", "f3", 1.0, "high", None, None), ("z4", "f4", 1.0, "high", None, None), ("z1", "f3", 1.0, "high", "1990-01-01", "1991-01-01")]
    sources = spark.createDataFrame([("s1",), ("s2",), ("s9",)], "source_id string")
    rows, lost = flow.compose(spark.createDataFrame(zones, ASSIGN), spark.createDataFrame(edges, EDGE), sources, "2024-01-01")
    got = {(r.zone, r.source_id): (r.share, r.confidence, r.basis) for r in rows.collect()}
    assert got == {("z1", "s1"): (0.7, "high", "measured"), ("z1", "s2"): (0.3, "high", "derived"), ("z2", "s1"): (0.35, "low", "published"), ("z2", "s2"): (0.15, "low", "derived"), ("z3", "s1"): (None, "high", "unknown"), ("z3", "s2"): (None, "high", "measured")}
    assert {r.zone: r.unresolved for r in lost.collect()} == {"z2": 0.5, "z4": 1.0}
    assert [r.g for r in flow.share_sums(spark.createDataFrame([("a", 0.5), ("a", 0.49), ("b", 1.004)], "g string, share double"), ["g"]).collect()] == ["a"]


def test_browsing(spark):
    df = spark.createDataFrame([(1, "100%", 5.0), (2, "a_b", None), (3, "", 7.0), (4, None, 9.0), (5, "A\\B", 1.0)], "id int, name string, v double")
    ids = lambda *f, **k: [r.id for r in tables.browse(df, list(f), order="id", **k).collect()]
    assert ids(("name", "contains", "%")) == [1] and ids(("name", "contains", "_")) == [2] and ids(("name", "contains", "a\\")) == [5] and ids(("name", "starts", "A")) == [2, 5]
    assert ids(("name", "isnull", None)) == [3, 4] and ids(("name", "notnull", None), ("v", ">=", "2")) == [1] and ids(("nope", "=", "1")) == [1, 2, 3, 4, 5]
    assert ids(("v", "=", "abc")) == [] and ids(("v", "!=", "5")) == [2, 3, 4, 5] and ids(search="A") == [2, 5]
    assert [r.id for r in tables.browse(df, order="v", descending=True).collect()][-1] == 2 and ids(offset=1, limit=2) == [2, 3]
    assert tables.capped_count(df, 3) == (3, False) and tables.capped_count(df, 5) == (5, True)
    stats = {r.name: r for r in tables.column_stats(df, ["name", "v"]).collect()}
    assert (stats["name"].n_empty, stats["name"].n_distinct, stats["v"].largest) == (2, 4, "9.0")


def test_keyset_pages_cover_everything(spark):
    df, after, seen = spark.range(7), None, []
    while True:
        page = tables.page_after(df, "id", after, 3).collect()
        seen += [r.id for r in page]
        after = page[0].next_after
        if after is None:
            break
    assert seen == list(range(7))
    assert all(r.next_after is None for r in tables.page_after(spark.range(3), "id", None, 3).collect())


@pytest.mark.parametrize("sql", ["DELETE FROM t", "select 1; select 2", "with x as (select 1) insert into t select * from x", "", "  -- select\n drop table t", "select 1 /* */; drop table t"])
def test_refused_sql(sql):
    with pytest.raises(ValueError):
        tables.checked_sql(sql)


def test_allowed_sql(spark):
    spark.range(5).createOrReplaceTempView("t_known")
    rows, more = tables.run_sql(spark, "-- note\nWITH x AS (SELECT id, 'drop; it' AS s FROM t_known) SELECT * FROM x ;", {"t_known", "x"}, most=3)
    assert rows.count() == 3 and more
    spark.range(5).createOrReplaceTempView("t_secret")
    with pytest.raises(ValueError):
        tables.run_sql(spark, "SELECT * FROM t_secret", {"t_known"})


def test_registry(spark):
    votes = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("b", None), ("c", None)], "k string, v string")
    assert {(r.k, r.v, r.n, r.n_ties) for r in registry.majority(votes, ["k"], "v").collect()} == {("a", "y", 2, 1), ("b", "x", 1, 2), ("c", None, 1, 1)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert {tuple(r) for r in registry.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in registry.upsert(old, new, ["k"], "ignore").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    taxa = spark.createDataFrame([("A a",), ("B b",), ("C c",), ("D d",)], "name string")
    lists = spark.createDataFrame([("A a", "pref", 2010, "EN"), ("A a", "pref", 2020, "VU"), ("A a", "national", 2020, "CR"), ("B b", "national", 2020, "NT"), ("C c x", "national", 2020, "VU"), ("C c y", "national", 2020, "CR")], "name string, scope string, year int, category string")
    got = {r.name: (r.category, r.method) for r in registry.red_list(taxa, lists, ["CR", "EN", "VU", "NT"]).collect()}
    assert got == {"A a": ("VU", "pref_exact"), "B b": ("NT", "national_exact"), "C c": ("CR", "subspecies"), "D d": (None, None)}


def test_document_totals(spark):
    rows = [("d", "t", "all", "c", 100.0, 1), ("d", "t", "all|x", "c", 60.0, 0), ("d", "t", "all|x|1", "c", 20.0, 0), ("d", "t", "all|y", "c", 40.2, 0), ("d", "t", "all", "e", 9.0, 1), ("d", "t", "all|x", "e", 2.0, 0), ("d", "t", "all|x", "e", 2.0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, table_id string, row_key string, col_key string, value double, is_total int")
    assert [(r.col_key, r.total, r.closest) for r in documents.total_failures(df).collect()] == [("e", 9.0, 4.0)]
    assert [(r.row_key, r["count"]) for r in documents.repeated_cells(df).collect()] == [("all|x", 2)]
    wide = spark.createDataFrame([("s1", "3", None), ("s2", " ", "0")], "site string, carp string, eel string")
    assert {tuple(r) for r in documents.melt(wide, ["site"]).collect()} == {("s1", "carp", 3.0), ("s2", "eel", 0.0)}
    assert documents.header_is_sound(["a", "b", "3"]) and not documents.header_is_sound(["1", None, "x"])


def test_days_of_hours_and_samples(spark):
    wide = spark.createDataFrame([("s", "temp", 1.0, 9999.0, 3.0), ("s", "wind", 1.0, 2.0, 3.0), ("s", "none", 9998.0, 9999.0, None)], "site string, item string, h1 double, h2 double, h3 double")
    got = {r.item: (r["mean"], r["min"], r["max"], r.n_valid, r.n_missing) for r in documents.hourly_to_daily(wide, ["site", "item"], ["h1", "h2", "h3"], circular=("wind",)).collect()}
    assert got == {"temp": (2.0, 1.0, 3.0, 2, 1), "none": (None, None, None, 0, 3)}
    long = spark.createDataFrame([("s", "2024-03-01T00:00", "5"), ("s", "2024-02-29T10:00", "7"), ("s", "2024-02-29T10:00", "7"), ("s", "2024-03-01T01:00", "--")], "site string, stamp string, value string")
    got = {r.day: (r["mean"], r.n_obs, r.n_marked) for r in documents.samples_to_daily(long, ["site"]).collect()}
    assert got == {"2024-02-29": (6.0, 2, 0), "2024-03-01": (None, 0, 1)}
    years = spark.createDataFrame([("k", 2001, "old"), ("k", 2003, "new")], "key string, year int, name string")
    assert tuple(documents.last_record(years, ["key"], "year", ["name"]).first()) == ("k", "new", 2001, 2003, 2)


def png(pixels):
    h, w, c = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2}[c], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_terrain(spark):
    pixels = np.array([[[0, 1, 0], [255, 255, 156]], [[128, 0, 0], [0, 0, 100]]], np.uint8)
    df = spark.createDataFrame([("a", bytearray(png(pixels)))], "path string, content binary")
    row = terrain.tiles(df).first()
    got = np.frombuffer(row.metres, np.float32).reshape(row.height, row.width)
    assert np.allclose(got[[0, 0, 1], [0, 1, 1]], [2.56, -1.0, 1.0], atol=1e-5) and np.isnan(got[1, 0])
    dem = np.array([[1, 5, 1], [1, 6, 1], [1, 5, 1.0]], np.float32)
    label = terrain.basins(dem)
    assert (label > 0).all()
    one = terrain.merged(label, np.ones_like(dem), 100.0)
    assert len(np.unique(one)) == 1
    assert terrain.circle_range(dem, 1.5, 1.5, 1.2) == (1.0, 6.0) and terrain.circle_range(np.full((2, 2), np.nan), 1, 1, 1) == (None, None)


def test_publishing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = store.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.publish(spark.range(9), path, [refuse])
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert store.publish(spark.range(5).repartition(3), path) == first
    package = store.export({"a": spark.range(4).withColumn("k", F.col("id") % 2), "b": spark.range(2)}, f"file://{tmp_path}/x", {"a": ["k"]})
    before = (tmp_path / "x/b").stat().st_mtime_ns
    again = store.export({"b": spark.range(2)}, f"file://{tmp_path}/x")
    assert (tmp_path / "x/b").stat().st_mtime_ns == before and not (tmp_path / "x/a").exists()
    assert again["resources"][0] == package["resources"][1]


def test_lineage(spark, tmp_path):
    c = store.Catalog(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError):
        c.read("facts")
    c.build("facts", lambda _: spark.range(3))
    c.build("cube", lambda cat: cat.read("facts").agg(F.sum("id").alias("s")))
    assert set(c.lineage["cube"]["from"]) == {"facts"} and c.read("cube").first().s == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名,値\n川,1\n".encode("cp932"))
    assert tuple(files.read_csv(spark, f"file://{tmp_path}/a.csv", "name string, value int", "windows-31j").first()) == ("川", 1)
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":"p","n":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"type":"Feature","properties":{"id":"q"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2]]],[[[5,5],[6,5],[6,6]]]]}}]}')
    got = {r.polygon_id: len(r.rings) for r in files.read_geojson(spark, f"file://{tmp_path}/g.geojson", "id").collect()}
    assert got == {"p": 1, "q": 2}
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>東京</t><rPh><t>トウキョウ</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>45000</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert files.read_xlsx(spark, f"file://{tmp_path}/b.xlsx").first().cells == ["東京", None, "45000"]
    assert files.serial_date(45000) == "2023-03-15"
    files.write_jsonl(spark.range(3), f"file://{tmp_path}/j")
    assert files.read_jsonl(spark, f"file://{tmp_path}/j", "id long").count() == 3


def test_darwin_core(spark):
    rows = [("o1", "e1", "2020", "l1", "net", "HumanObservation", "A\tb", "present", "CC0"), ("o2", "e1", "2021", "l1", "net", "HumanObservation", "C d", "present", "CC0"), ("o3", "e2", "2021", "l1", "net", "HumanObservation", "E f", "present", "closed")]
    df = spark.createDataFrame(rows, "occurrenceID string, eventID string, eventDate string, locationID string, samplingProtocol string, basisOfRecord string, scientificName string, occurrenceStatus string, license string")
    out = files.darwin_core(df, ["CC0"])
    assert [tuple(r) for r in out["event"].collect()] == [("e1", "2020", "l1", "net")] and out["occurrence"].count() == 2
    assert {r.scientificName for r in out["occurrence"].collect()} == {"A b", "C d"}
    assert 'id index="0"' in files.meta_xml(out) and 'coreid index="1"' in files.meta_xml(out)


def test_envelope(spark):
    cells = spark.createDataFrame([("a", "2020", 1.0, 2.0, 3, 1, 0, "mg"), ("b", "2021", 2.0, 2.0, 1, 0, 1, "mg")], "place_id string, period_start string, value_zero double, value_lod double, n long, n_censored long, n_not_detected long, unit_id string")
    e = envelope.build({"variable": "v"}, cells, "both", limit=1)
    assert e.truncated and e.rows.count() == 1 and e.coverage == {"n_places": 2, "from": "2020", "to": "2021", "n": 4, "n_censored": 1, "n_not_detected": 1, "unit": "mg"}
    assert [c["name"] for c in e.columns] == ["place_id", "period_start", "value_zero", "value_lod"]
    facets = spark.createDataFrame(envelope.series_facets("v", "water", ["s"]), "order int, kind string, ref string")
    scopes = spark.createDataFrame([("c1", "source", "s"), ("c2", "variable", "v"), ("c1", "variable", "v"), ("c3", "theme", "air")], "caveat_key string, kind string, ref string")
    texts = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c3", "z")], "caveat_key string, text string")
    assert [r.caveat_key for r in envelope.caveats_for(facets, scopes, texts).collect()] == ["c1", "c2"]
    editions = spark.createDataFrame([("e1", "s", "2020", "first"), ("e2", "s", "2021", "second"), ("e3", "t", "2020", "x")], "edition_id string, source_id string, vintage string, label string")
    assert envelope.edition(editions, "s", "2021") == "e2" and envelope.edition(editions, "t") == "e3"
    for bad in (("s",), ("none",), ("s", "1999")):
        with pytest.raises(ValueError):
            envelope.edition(editions, *bad)


def test_samples(spark):
    facts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "id int, place string")
    places = spark.createDataFrame([("p1", "r1"), ("p2", "r2"), ("p3", "r1")], "place string, region string")
    regions = spark.createDataFrame([("r1",), ("r2",)], "region string")
    out = sampling.closure({"facts": facts, "places": places, "regions": regions}, {"facts": facts.filter("id < 2")}, [("facts", "place", "places", "place"), ("places", "region", "regions", "region")])
    assert out["places"].count() == 1 and out["regions"].first().region == "r1"
    a, b = sampling.snapshot(places, []), sampling.snapshot(places.repartition(4), [])
    assert a == b and sampling.degenerate([{"rows": 1}, {"rows": 0}]) and not sampling.degenerate([a])


def test_streaming_daily(spark, tmp_path):
    from shizuku.streaming import rollup

    rows = spark.createDataFrame([("p", "v", "2024-01-01 10:00:00", 1.0), ("p", "v", "2024-01-02 00:00:00", 3.0), ("p", "v", "2024-01-09 00:00:01", 9.0)], "place_id string, variable_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = rollup.upsert_daily(rollup.daily(stream, hour_ending=True), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.day, r["mean"], r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert got == [("2024-01-01", 2.0, 2)]
