"""Document series, record sets, dataset search, eDNA, table browsing, geometry and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shizuku.functions import censoring, naming, periods
from shizuku.operators import checks, flow, registry, spatial, tables
from shizuku.plans.domain import query, table

# Documents as tables of cells: a row key is source|lang, a fiscal year comes from the id, the value from n_chars.
_CELLS = "cells AS (SELECT source AS doc, source || '|' || lang AS row_key, 2000 + doc_id // 97 % 10 AS fiscal_year, n_chars AS value, doc_id % 50 AS page_no, CASE WHEN doc_id % 7 = 0 THEN '%' ELSE 'c' END AS unit, doc_id % 13 = 0 AS superseded, lang FROM documents)"
_VALID = "NOT superseded AND value IS NOT NULL AND row_key <> ''"
_POINTS = f"{_CELLS}, points AS (SELECT doc, row_key, fiscal_year, min(value // 20000) AS value, max(unit) AS unit, min(page_no) AS page_no FROM cells WHERE {_VALID} GROUP BY ALL HAVING min(value // 20000) = max(value // 20000))"


def _cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("doc"), F.concat("source", F.lit("|"), "lang").alias("row_key"), (2000 + F.floor(F.col("doc_id") / 97) % 10).alias("fiscal_year"), F.floor(F.col("n_chars") / 20000).alias("value"), (F.col("doc_id") % 50).alias("page_no"), F.when(F.col("doc_id") % 7 == 0, "%").otherwise("c").alias("unit"), (F.col("doc_id") % 13 == 0).alias("superseded"))


def _points(spark, sf_dir):
    """Points of document series; a year with more than one value of a row has none."""
    rows = _cells(spark, sf_dir).filter("NOT superseded AND value IS NOT NULL AND row_key <> ''").groupBy("doc", "row_key", "fiscal_year")
    return rows.agg(F.min("value").alias("value"), F.max("value").alias("most"), F.max("unit").alias("unit"), F.min("page_no").alias("page_no")).filter("value = most").drop("most")


@query(f"WITH {_POINTS} SELECT * FROM points")
def doc_points(spark, sf_dir):
    return _points(spark, sf_dir)


@query(f"WITH {_POINTS}, w AS (SELECT doc, count(*) FILTER (WHERE superseded) AS warnings FROM cells GROUP BY ALL) SELECT p.doc, row_key, trim(split_part(row_key, '|', 2)) AS label, count(*) AS n_years, min(fiscal_year) AS y_from, max(fiscal_year) AS y_to, any_value(warnings) AS warnings FROM points p JOIN w USING (doc) GROUP BY p.doc, row_key HAVING count(*) >= 2")
def doc_series_list(spark, sf_dir):
    warned = _cells(spark, sf_dir).groupBy("doc").agg(F.count_if("superseded").alias("warnings"))
    rows = _points(spark, sf_dir).groupBy("doc", "row_key").agg(F.count("*").alias("n_years"), F.min("fiscal_year").alias("y_from"), F.max("fiscal_year").alias("y_to"))
    return rows.filter("n_years >= 2").join(warned, "doc").withColumn("label", naming.row_label(F.col("row_key")))


@query("WITH n AS (SELECT doc_id, count(*) AS n_labels, CAST(sum(toxic) AS BIGINT) AS blocking FROM labels GROUP BY ALL) SELECT doc_id, lang, source, coalesce(n_labels, 0) AS n_labels, coalesce(blocking, 0) AS blocking FROM documents LEFT JOIN n USING (doc_id)")
def documents_counts(spark, sf_dir):
    notes = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n_labels"), F.sum(F.col("toxic").cast("long")).alias("blocking"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(notes, "doc_id", "left")
    return rows.withColumn("n_labels", F.coalesce("n_labels", F.lit(0))).withColumn("blocking", F.coalesce("blocking", F.lit(0)))


@query("WITH r AS (SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 200 AND 5000 AND doc_id > 100), p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM r) SELECT doc_id, lang, n_chars, CASE WHEN n > 50 THEN (SELECT doc_id FROM p WHERE place = 50) END AS next_after FROM p WHERE place <= 50")
def records_keyset(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").filter(F.col("lang") == "en").filter(F.col("n_chars").between(200, 5000))
    return tables.page_after(rows, "doc_id", 100, 50)


@query("SELECT doc_id, source, n_chars FROM documents d WHERE lower(text) LIKE '%license%' AND lower(text) LIKE '%version%' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND n_chars > 100")
def dataset_search_and(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    text = F.lower("text")
    hits = table(spark, sf_dir, "documents").filter(text.contains("license") & text.contains("version") & (F.col("n_chars") > 100))
    return hits.join(labels, "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query("SELECT count(*) FILTER (WHERE n_chars IS NULL) AS without_date, count(*) FILTER (WHERE n_chars >= 1000) AS matching FROM documents")
def dataset_search_excluded(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_if(F.col("n_chars").isNull()).alias("without_date"), F.count_if(F.col("n_chars") >= 1000).alias("matching"))


@query("SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn > 5 AND rn <= 11")
def resources_rownum(spark, sf_dir):
    """The second page of five, and one row more, of each dataset's resources."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id").withColumn("rn", rn).filter("rn > 5 AND rn <= 11")


@query("SELECT d.doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_records(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


_EDNA = "e AS (SELECT user_id AS site, event_type AS taxon, strftime(ts, '%Y-%m-%d') AS event, max(CASE WHEN value >= 1 THEN 1 ELSE 0 END) AS detected, count(*) AS reads FROM events GROUP BY ALL)"


def _edna(spark, sf_dir):
    """Reads folded to one row for each site, taxon and sampling day."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("site"), F.col("event_type").alias("taxon"), F.date_format("ts", "yyyy-MM-dd").alias("event"))
    return rows.agg(F.max(F.when(F.col("value") >= 1, 1).otherwise(0)).alias("detected"), F.count("*").alias("reads"))


@query(f"WITH {_EDNA} SELECT site, count(DISTINCT event) AS n_events, count(DISTINCT CASE WHEN detected = 1 THEN taxon END) AS n_taxa, CAST(sum(reads) AS BIGINT) AS reads FROM e GROUP BY ALL")
def edna_by_site(spark, sf_dir):
    return _edna(spark, sf_dir).groupBy("site").agg(F.countDistinct("event").alias("n_events"), F.countDistinct(F.when(F.col("detected") == 1, F.col("taxon"))).alias("n_taxa"), F.sum("reads").alias("reads"))


@query(f"WITH {_EDNA} SELECT taxon, count(DISTINCT site) AS n_sites, CAST(sum(detected) AS BIGINT) AS n_detected, count(*) AS n_events FROM e GROUP BY ALL")
def edna_by_taxon(spark, sf_dir):
    return _edna(spark, sf_dir).groupBy("taxon").agg(F.countDistinct("site").alias("n_sites"), F.sum(F.col("detected").cast("long")).alias("n_detected"), F.count("*").alias("n_events"))


@query("SELECT 'lang' AS name, count(*) AS n, count(*) FILTER (WHERE lang IS NULL OR lang = '') AS n_empty, count(DISTINCT lang) AS n_distinct, min(lang) AS smallest, max(lang) AS largest FROM documents UNION ALL SELECT 'n_chars', count(*), count(*) FILTER (WHERE n_chars IS NULL), count(DISTINCT n_chars), CAST(min(n_chars) AS VARCHAR), CAST(max(n_chars) AS VARCHAR) FROM documents")
def column_stats(spark, sf_dir):
    return tables.column_stats(table(spark, sf_dir, "documents"), ["lang", "n_chars"])


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY ALL ORDER BY count DESC, value LIMIT 3")
def top_values(spark, sf_dir):
    return tables.top_values(table(spark, sf_dir, "events"), "event_type", 3)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0 AND lower(c_name) LIKE '%00%' AND c_mktsegment <> 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10")
def table_browse(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    filters = [("c_acctbal", ">=", "0"), ("c_name", "contains", "00"), ("c_mktsegment", "!=", "BUILDING"), ("nothing", "=", "1")]
    return tables.browse(rows, filters, order="c_acctbal", descending=True, offset=10, limit=20).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def guarded_sql(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    rows, _ = tables.run_sql(spark, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment;", {"customer"})
    return rows


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"] % 5
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, min(turn) AS first_turn, count(DISTINCT turn) AS n_turns FROM conversations GROUP BY ALL")
def last_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.max("turn").alias("last_turn"), F.max(F.struct("turn", "role"))["role"].alias("last_role"), F.min("turn").alias("first_turn"), F.countDistinct("turn").alias("n_turns"))


@query("WITH v AS (SELECT CASE s_suppkey % 5 WHEN 0 THEN '<' || (s_suppkey % 7) || '.5' WHEN 1 THEN 'ND' WHEN 2 THEN '>' || (s_suppkey % 11) WHEN 3 THEN (s_suppkey % 13) || '未満' ELSE CAST(s_suppkey AS VARCHAR) END AS raw FROM supplier) SELECT CASE WHEN raw LIKE '<%' OR raw LIKE '%未満' THEN 'below_lod' WHEN raw = 'ND' THEN 'not_detected' WHEN raw LIKE '>%' THEN 'above_lod' ELSE 'none' END AS censoring, CASE WHEN raw LIKE '<%' OR raw LIKE '>%' THEN CAST(substr(raw, 2) AS DOUBLE) WHEN raw LIKE '%未満' THEN CAST(replace(raw, '未満', '') AS DOUBLE) END AS censoring_limit, count(*) AS n FROM v GROUP BY ALL")
def censoring_classes(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("<"), (k % 7).cast("string"), F.lit(".5"))).when(k % 5 == 1, "ND").when(k % 5 == 2, F.concat(F.lit(">"), (k % 11).cast("string"))).when(k % 5 == 3, F.concat((k % 13).cast("string"), F.lit("未満"))).otherwise(k.cast("string"))
    rows = table(spark, sf_dir, "supplier").select(raw.alias("raw")).withColumn("c", censoring.classify(F.col("raw")))
    return rows.groupBy("c.censoring", "c.censoring_limit").agg(F.count("*").alias("n"))


_SHAPED = "s AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || '/' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T03:30Z' END AS label, o_orderkey % 5 AS k, o_orderdate AS d FROM orders)"


@query(f"WITH {_SHAPED}, p AS (SELECT k, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'survey_period' ELSE 'instant' END AS period_grain, CASE k WHEN 0 THEN label || '-01-01' WHEN 1 THEN label || '-01' WHEN 2 THEN label WHEN 3 THEN split_part(label, '/', 1) ELSE strftime(d, '%Y-%m-%d') || 'T12:30:00' END AS period_start, CASE k WHEN 0 THEN label || '-12-31' WHEN 1 THEN strftime(last_day(d), '%Y-%m-%d') WHEN 2 THEN label WHEN 3 THEN split_part(label, '/', 2) ELSE strftime(d, '%Y-%m-%d') || 'T12:30:00' END AS period_end FROM s) SELECT period_grain, period_start, period_end, count(*) AS n FROM p GROUP BY ALL")
def observed_periods(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    f = lambda x, p: F.date_format(x, p)
    label = F.when(k == 0, f(d, "yyyy")).when(k == 1, f(d, "yyyy-MM")).when(k == 2, f(d, "yyyy-MM-dd")).when(k == 3, F.concat(f(d, "yyyy-MM-dd"), F.lit("/"), f(d + F.expr("INTERVAL 40 DAY"), "yyyy-MM-dd"))).otherwise(F.concat(f(d, "yyyy-MM-dd"), F.lit("T03:30Z")))
    rows = table(spark, sf_dir, "orders").select(label.alias("label")).groupBy("label").count()  # labels repeat: each is read once
    rows = periods.with_observed_period(rows, "label", "p")
    return rows.groupBy("p.period_grain", "p.period_start", "p.period_end").agg(F.sum("count").alias("n"))


@query("WITH o AS (SELECT c_custkey AS k, floor(c_acctbal / 100) AS gx, floor(-c_acctbal / 100) AS gy FROM customer) SELECT 'grid01:' || CAST(gx AS BIGINT) || ',' || CAST(gy AS BIGINT) AS cell, count(*) AS n FROM o GROUP BY ALL")
def grid_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 100).alias("x"))
    return rows.groupBy(naming.grid_id(F.col("x"), -F.col("x"), 1).alias("cell")).agg(F.count("*").alias("n"))


# Geometry: customers as points, rectangles of the plane as polygons (one with a hole).
_POLYGONS = [("a", 0.0, 0.0, 30.0, 40.0), ("b", 30.0, 0.0, 70.0, 40.0), ("c", 0.0, 40.0, 70.0, 101.0)]


@query("WITH p AS (SELECT DISTINCT (c_acctbal + 0.5) / 100 AS lon, (c_custkey % 100) + 0.123 AS lat FROM customer), q AS (SELECT *, CASE WHEN lon > 0 AND lon < 30 AND lat > 0 AND lat < 40 AND NOT (lon > 10 AND lon < 20 AND lat > 10 AND lat < 20) THEN 'a' WHEN lon > 30 AND lon < 70 AND lat > 0 AND lat < 40 THEN 'b' WHEN lon > 0 AND lon < 70 AND lat > 40 AND lat < 101 THEN 'c' END AS polygon_id FROM p) SELECT polygon_id, count(*) AS n FROM q WHERE polygon_id IS NOT NULL GROUP BY ALL")
def pip_grid_join(spark, sf_dir):
    """Distinct points by polygon. Balances of whole cents lie on edges now and then: outside of a rectangle, but within it on the edge of its hole."""
    ring = lambda x1, y1, x2, y2: [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]
    rows = [(n, [ring(*box)] + ([ring(10.0, 10.0, 20.0, 20.0)] if n == "a" else [])) for n, *box in _POLYGONS]
    polygons = spark.createDataFrame(rows, "polygon_id string, rings array<array<array<double>>>")
    points = table(spark, sf_dir, "customer").select(((F.col("c_acctbal") + 0.5) / 100).alias("lon"), (F.col("c_custkey") % 100 + 0.123).alias("lat"))
    return spatial.point_in_polygon(points, polygons, strict=False).groupBy("polygon_id").agg(F.count("*").alias("n"))


def _points_and_places(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(c.alias("point_id"), ((c % 40) / 10.0).alias("lat"), ((c % 37) / 10.0).alias("lon"))
    places = table(spark, sf_dir, "supplier").select(F.concat(F.lit("site:"), s).alias("place_id"), ((s % 17) / 4.0).alias("lat"), ((s % 13) / 3.0).alias("lon"))
    return points, places


_KM = "2 * 6371.0088 * asin(sqrt(least(power(sin(radians(s.lat - u.lat) / 2), 2) + cos(radians(u.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - u.lon) / 2), 2), 1.0)))"
_PAIRS = f"p AS (SELECT c_custkey AS point_id, (c_custkey % 40) / 10.0 AS lat, (c_custkey % 37) / 10.0 AS lon FROM customer), u AS (SELECT DISTINCT lat, lon FROM p), s AS (SELECT (s_suppkey % 17) / 4.0 AS lat, (s_suppkey % 13) / 3.0 AS lon, min('site:' || s_suppkey) AS place_id FROM supplier GROUP BY ALL), d AS (SELECT u.lat, u.lon, min({_KM}) AS km FROM u, s GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT point_id, round(km, 6) AS km FROM p JOIN d ON p.lat = d.lat AND p.lon = d.lon WHERE km <= 50")
def nearest_place(spark, sf_dir):
    points, places = _points_and_places(spark, sf_dir)
    return spatial.nearest(points, places, 50.0).select("point_id", F.round("km", 6).alias("km"))


@query(f"""WITH p AS (SELECT o_orderkey AS point_id, o_orderkey % 170 - 85.0 AS lat, o_orderkey % 359 - 179.5 AS lon FROM orders), u AS (SELECT DISTINCT lat, lon FROM p),
s AS (SELECT (s_suppkey % 6) * 7.0 - 20 AS lat, (s_suppkey % 5) * 9.0 + 100.25 AS lon, min('site:' || s_suppkey) AS place_id FROM supplier GROUP BY ALL),
d AS (SELECT u.lat, u.lon, s.place_id, {_KM} AS km FROM u, s), m AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY round(km, 6), place_id) AS rn FROM d)
SELECT point_id, round(km, 4) AS km, place_id FROM p JOIN m ON p.lat = m.lat AND p.lon = m.lon WHERE rn = 1""")
def nearest_anywhere(spark, sf_dir):
    """The nearest place of points all over the globe, most of them thousands of kilometres from any; places that share a coordinate count as that with the smallest id."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "orders").select(k.alias("point_id"), (k % 170 - 85.0).alias("lat"), (k % 359 - 179.5).alias("lon"))
    places = table(spark, sf_dir, "supplier").select(F.concat(F.lit("site:"), s).alias("place_id"), (s % 6 * 7.0 - 20).alias("lat"), (s % 5 * 9.0 + 100.25).alias("lon"))
    return spatial.nearest_any(points, places).select("point_id", F.round("km", 4).alias("km"), "place_id")


@query("""WITH p AS (SELECT DISTINCT o_orderkey % 977 / 97.0 + 0.003 AS lon, o_orderkey % 613 / 61.0 + 0.0007 AS lat FROM orders), q AS (SELECT lon, lat, CAST(floor(lon) AS INTEGER) AS x, CAST(floor(lat) AS INTEGER) AS y, lon - floor(lon) AS a, lat - floor(lat) AS b FROM p),
r AS (SELECT *, CASE WHEN x % 3 = 0 THEN a + b < 1 ELSE NOT (a > 0.25 AND a < 0.75 AND b > 0.25 AND b < 0.5) END AS in_one, a < 0.5 AS west FROM q WHERE x < 10 AND y < 10)
SELECT 'n' || (x % 5) || ':' || y AS polygon_id, count(*) AS n FROM r WHERE in_one AND (x < 5 OR west) GROUP BY ALL""")
def points_in_parts(spark, sf_dir):
    """Distinct points in fifty polygons of two parts each, five degrees apart: triangles, squares with a hole, and halves of them."""
    n = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select((n % 5).alias("x"), (n / 5).cast("int").alias("y")).withColumn("y", F.explode(F.array(F.col("y"), F.col("y") + 5)))
    at = lambda px, py: F.array((px).cast("double"), (py).cast("double"))

    def ring(dx, corners):
        return F.array(*(at(F.col("x") + dx + a, F.col("y") + b) for a, b in corners))

    square, hole, half, half_hole = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.5), (0.25, 0.5)], [(0, 0), (0.5, 0), (0.5, 1), (0, 1)], [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5)]
    triangle, cut = [(0, 0), (1, 0), (0, 1)], [(0, 0), (0.5, 0), (0.5, 0.5), (0, 1)]
    slanted = lambda dx: (F.col("x") + dx) % 3 == 0
    first = F.when(slanted(0), F.array(ring(0, triangle))).otherwise(F.array(ring(0, square), ring(0, hole)))
    second = F.when(slanted(5), F.array(ring(5, cut))).otherwise(F.array(ring(5, half), ring(5, half_hole)))
    polygons = base.select(F.concat(F.lit("n"), "x", F.lit(":"), "y").alias("polygon_id"), F.concat(first, second).alias("rings"))
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select((k % 977 / 97.0 + 0.003).alias("lon"), (k % 613 / 61.0 + 0.0007).alias("lat"))
    return spatial.point_in_polygon(points, polygons).groupBy("polygon_id").agg(F.count("*").alias("n"))


_EDGES = [("f1", "s1", 0.6, "measured"), ("f1", "s2", 0.4, "published"), ("f2", "f1", 0.5, "estimated"), ("f2", "s3", 0.5, "measured"), ("f3", "s1", None, "unknown"), ("f3", "s2", 0.3, "measured"), ("f4", "nowhere", 1.0, "measured")]


@query("""WITH z(zone, facility, zs) AS (SELECT n_nationkey, 'f' || (1 + n_nationkey % 4), 1.0::DOUBLE FROM nation),
b(facility, source_id, share, basis) AS (VALUES ('f1', 's1', 0.6::DOUBLE, 'measured'), ('f1', 's2', 0.4, 'published'), ('f2', 's1', 0.3, 'estimated'), ('f2', 's2', 0.2, 'estimated'), ('f2', 's3', 0.5, 'measured'), ('f3', 's1', NULL, 'unknown'), ('f3', 's2', NULL, 'measured'))
SELECT zone, source_id, round(zs * share, 6) AS share, 'high' AS confidence, basis FROM z JOIN b USING (facility)""")
def flow_compose(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    none = F.lit(None).cast("string")
    assignments = nations.select(F.col("n_nationkey").alias("zone"), F.concat(F.lit("f"), (1 + F.col("n_nationkey") % 4).cast("string")).alias("facility_id"), F.lit(1.0).alias("share"), F.lit("high").alias("confidence"), none.alias("valid_from"), none.alias("valid_to"))
    edges = spark.createDataFrame([(*e, None, None) for e in _EDGES] + [("f1", "s9", 1.0, "measured", "2000-01-01", "2010-01-01")], "to_id string, from_id string, share double, basis string, valid_from string, valid_to string")
    sources = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s9",)], "source_id string")
    return flow.compose(assignments, edges, sources, "2024-04-01")[0]


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS at, 'n' || (n_nationkey * 2) % 25 AS up, 0.5::DOUBLE AS share FROM nation UNION ALL SELECT 'n' || n_nationkey, 's' || n_regionkey, 0.3 FROM nation WHERE n_nationkey % 3 = 0),
w(zone, node, share, seen, n) AS (SELECT s_suppkey, 'n' || s_nationkey, 1.0::DOUBLE, ['n' || s_nationkey], 0 FROM supplier
  UNION ALL SELECT zone, up, w.share * e.share, list_append(seen, up), n + 1 FROM w JOIN e ON e.at = w.node WHERE NOT list_contains(seen, up) AND n < 33),
c AS (SELECT zone, 'unresolved' AS source_id, sum(w.share * e.share) AS share FROM w JOIN e ON e.at = w.node WHERE list_contains(seen, up) GROUP BY zone)
SELECT zone, node AS source_id, round(sum(share), 6) AS share FROM w WHERE node LIKE 's%' GROUP BY ALL UNION ALL SELECT zone, source_id, round(share, 6) FROM c WHERE round(share, 6) > 0""")
def flow_with_cycles(spark, sf_dir):
    """Suppliers as zones, fed through a graph of nations that has cycles of one, four and twenty nodes, and what runs into them."""
    n, none = F.col("n_nationkey"), F.lit(None).cast("string")
    name = lambda c, letter="n": F.concat(F.lit(letter), c.cast("string"))
    edge = lambda rows, up, share: rows.select(name(n).alias("to_id"), up.alias("from_id"), F.lit(share).alias("share"), F.lit("measured").alias("basis"), none.alias("valid_from"), none.alias("valid_to"))
    nations = table(spark, sf_dir, "nation")
    edges = edge(nations, name(n * 2 % 25), 0.5).unionByName(edge(nations.filter("n_nationkey % 3 = 0"), name(F.col("n_regionkey"), "s"), 0.3))
    sources = table(spark, sf_dir, "region").select(name(F.col("r_regionkey"), "s").alias("source_id"))
    assignments = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone"), name(F.col("s_nationkey")).alias("facility_id"), F.lit(1.0).alias("share"), F.lit("high").alias("confidence"), none.alias("valid_from"), none.alias("valid_to"))
    shares, lost = flow.compose(assignments, edges, sources, "2024-04-01")
    return shares.select("zone", "source_id", "share").unionByName(lost.select("zone", F.lit("unresolved").alias("source_id"), F.col("unresolved").alias("share")))


@query("SELECT l_suppkey AS grp, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY ALL HAVING abs(sum(l_discount) - 1) > 0.005")
def share_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_discount").alias("share"))
    return flow.share_sums(rows, ["grp"]).withColumn("total", F.round("total", 6))


@query("WITH u AS (SELECT n_nationkey AS key, 'explicit' AS facility_id FROM nation WHERE n_nationkey < 5), r AS (SELECT DISTINCT n_nationkey AS key, f AS facility_id FROM nation JOIN (VALUES ('city_exact', 1, NULL, 'c1'), ('prefix', 2, 'I', 'p2'), ('key_prefix', 3, '2', 'k3')) t(kind, city, pattern, f) ON n_regionkey = city AND (kind = 'city_exact' OR kind = 'prefix' AND n_name LIKE pattern || '%' OR kind = 'key_prefix' AND CAST(n_nationkey AS VARCHAR) LIKE pattern || '%')) SELECT CAST(key AS VARCHAR) AS key, facility_id FROM u UNION ALL SELECT CAST(key AS VARCHAR), facility_id FROM r WHERE key NOT IN (SELECT key FROM u)")
def zone_rules(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rules = spark.createDataFrame([("city_exact", 1, None, "c1"), ("prefix", 2, "I", "p2"), ("key_prefix", 3, "2", "k3")], "kind string, city int, pattern string, facility_id string")
    keys = n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").alias("city"), F.col("n_name").alias("name"))
    explicit = n.filter("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("key"), F.lit("explicit").alias("facility_id"))
    return flow.expand_rules(rules, keys, explicit)


# Building and checking tables.


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT 1000000000 + s_suppkey, 'added' FROM supplier")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = old.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("new"))
    added = table(spark, sf_dir, "supplier").select((F.lit(1000000000) + F.col("s_suppkey")).alias("c_custkey"), F.lit("added").alias("segment"))
    return registry.upsert(old, changed.unionByName(added), ["c_custkey"])


@query("WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 0), d AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (0, 2, 4)) SELECT k AS n_nationkey, 'missing' AS side FROM d WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'stale' FROM a WHERE k NOT IN (SELECT k FROM d)")
def declared_difference(spark, sf_dir):
    """Nations with a supplier in debt against nations of every other region."""
    actual = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return checks.set_difference(actual, table(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(0, 2, 4)), ["n_nationkey"])


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), d AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT k AS c_custkey, 'missing' AS side FROM (SELECT k FROM d EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'stale' FROM (SELECT k FROM a EXCEPT SELECT k FROM d)")
def declared_difference_all(spark, sf_dir):
    """Customers with orders against customers in credit."""
    actual = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return checks.set_difference(actual, table(spark, sf_dir, "customer").filter("c_acctbal > 0"), ["c_custkey"])


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'synthetic' WHEN o_orderpriority LIKE '5%' THEN 'absent' WHEN o_totalprice < 20000 THEN 'unknown_status' END AS excluded_by, count(*) AS n FROM orders GROUP BY ALL")
def exclusion_reasons(spark, sf_dir):
    reasons = [("synthetic", F.col("o_orderstatus") == "P"), ("absent", F.col("o_orderpriority").startswith("5")), ("unknown_status", F.col("o_totalprice") < 20000)]
    return registry.excluded(table(spark, sf_dir, "orders"), reasons).groupBy("excluded_by").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'area' END AS m, l_quantity AS area, l_extendedprice AS price FROM lineitem) SELECT l_orderkey, l_linenumber, 'area' AS measure, area AS value FROM d UNION ALL SELECT l_orderkey, l_linenumber, 'price', price FROM d")
def unpivot_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("price"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["area", "price"], "measure", "value")


@query("SELECT p_brand, p_type, CASE WHEN p_type LIKE 'PROMO%' THEN 'promoted' WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'dear' ELSE 'other' END AS zone, count(*) AS n FROM part GROUP BY ALL")
def zone_rule(spark, sf_dir):
    rules = [(F.col("p_type").startswith("PROMO"), "promoted"), (F.col("p_size") < 10, "small"), (F.col("p_retailprice") > 1500, "dear")]
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", naming.first_rule(rules, F.lit("other")).alias("zone")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS binom FROM part WHERE p_name LIKE '% %') SELECT binom, lower(binom) AS key, count(*) AS n FROM a GROUP BY ALL")
def binomials(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(naming.binomial(F.col("p_name")).alias("binom")).filter("binom IS NOT NULL")
    return rows.groupBy("binom", naming.taxon_key(F.col("binom")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders")
def fingerprint_rows(spark, sf_dir):
    """The rows of a table and its keys; the hash itself is Spark's own and is compared between runs, not with SQL."""
    from shizuku.sources.tables import fingerprint

    rows = table(spark, sf_dir, "orders")
    print_of = fingerprint(rows)
    return rows.agg(F.lit("orders").alias("name"), F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys")).filter(F.lit(len(print_of["hash"]) > 0))
