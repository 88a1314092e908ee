"""Smaller rules of the domain over the driver's tables: overlays, validity, units, comparisons, inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shizuku.functions import naming
from shizuku.operators import checks, documents, flow, mesh, registry, sampling
from shizuku.plans.domain import query, table


@query("WITH v AS (SELECT source, 2000 + doc_id // 100 AS fiscal_year, CASE WHEN n_chars < 500 THEN '<5' ELSE CAST(n_chars // 100 AS VARCHAR) END AS raw FROM documents) SELECT source, fiscal_year, round(avg(TRY_CAST(raw AS DOUBLE)), 6) AS cover, count(*) FILTER (WHERE raw = '<5') AS n_below, count(*) AS n FROM v GROUP BY ALL")
def cover_per_year(spark, sf_dir):
    """Means of what is a number; what lies below the limit is counted beside it."""
    raw = F.when(F.col("n_chars") < 500, "<5").otherwise(F.floor(F.col("n_chars") / 100).cast("string"))
    rows = table(spark, sf_dir, "documents").select("source", (2000 + F.floor(F.col("doc_id") / 100)).alias("fiscal_year"), raw.alias("raw"))
    return rows.groupBy("source", "fiscal_year").agg(F.round(F.avg(F.col("raw").try_cast("double")), 6).alias("cover"), F.count_if(F.col("raw") == "<5").alias("n_below"), F.count("*").alias("n"))


@query("SELECT p_brand, median(p_retailprice) AS median, round(avg(CASE WHEN abs(p_size - 25) <= 10 THEN 1.0 ELSE 0.0 END), 6) AS within FROM part GROUP BY ALL")
def median_and_share(spark, sf_dir):
    near = F.when(F.abs(F.col("p_size") - 25) <= 10, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("median"), F.round(F.avg(near), 6).alias("within"))


@query("SELECT s_name, CAST(regexp_extract(s_name, '(\\d+)', 1) AS BIGINT) AS number FROM supplier ORDER BY number DESC, s_name LIMIT 15")
def leading_numbers(spark, sf_dir):
    number = F.regexp_extract("s_name", r"(\d+)", 1).try_cast("long")
    return table(spark, sf_dir, "supplier").select("s_name", number.alias("number")).orderBy(F.desc("number"), "s_name").limit(15)


@query("SELECT c_custkey FROM customer WHERE c_acctbal / 100 BETWEEN 10 - 0.5 AND 20 + 0.5 AND c_custkey % 100 BETWEEN 30 - 0.5 AND 60 + 0.5")
def bbox_overlay(spark, sf_dir):
    """Points in a box with a margin around it."""
    margin = 0.5
    rows = table(spark, sf_dir, "customer").filter((F.col("c_acctbal") / 100).between(10 - margin, 20 + margin) & (F.col("c_custkey") % 100).between(30 - margin, 60 + margin))
    return rows.select("c_custkey")


@query("SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_linenumber % 3 > 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS valid_from, CASE WHEN l_linenumber % 2 > 0 THEN strftime(l_shipdate + INTERVAL 400 DAY, '%Y-%m-%d') END AS valid_to FROM lineitem) WHERE (valid_from IS NULL OR valid_from <= '1998-01-01') AND (valid_to IS NULL OR '1998-01-01' < valid_to) GROUP BY ALL")
def valid_as_of(spark, sf_dir):
    start = F.when(F.col("l_linenumber") % 3 > 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
    end = F.when(F.col("l_linenumber") % 2 > 0, F.date_format(F.col("l_shipdate") + F.expr("INTERVAL 400 DAY"), "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", start.alias("valid_from"), end.alias("valid_to"))
    return rows.filter(flow.active("1998-01-01")).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("WITH u(unit, canonical, scale) AS (VALUES ('F', 'mg', 1000.0::DOUBLE), ('O', 'mg', 1.0)) SELECT l_linestatus AS unit, coalesce(canonical, l_linestatus) AS canonical_unit, CAST(sum(l_quantity * coalesce(scale, 1.0)) AS DOUBLE) AS total FROM lineitem LEFT JOIN u ON unit = l_linestatus GROUP BY ALL")
def canonical_units(spark, sf_dir):
    units = spark.createDataFrame([("F", "mg", 1000.0), ("O", "mg", 1.0)], "unit string, canonical string, scale double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("unit"), "l_quantity").join(F.broadcast(units), "unit", "left")
    value = naming.canonical_value(F.col("l_quantity"), F.col("scale"))
    return rows.groupBy("unit", F.coalesce("canonical", "unit").alias("canonical_unit")).agg(F.sum(value).alias("total"))


@query("WITH d AS (SELECT lang AS item, source AS doc, CAST(max(n_chars) // 5000 AS BIGINT) AS value FROM documents GROUP BY ALL) SELECT item, count(*) AS n_docs, min(value) AS least, max(value) AS most, count(DISTINCT value) = 1 AS agreed FROM d GROUP BY ALL")
def compared_documents(spark, sf_dir):
    """Items that several documents report, and whether all agree."""
    per = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("item"), F.col("source").alias("doc")).agg(F.floor(F.max("n_chars") / 5000).alias("value"))
    return per.groupBy("item").agg(F.count("*").alias("n_docs"), F.min("value").alias("least"), F.max("value").alias("most"), (F.countDistinct("value") == 1).alias("agreed"))


@query("WITH t AS (SELECT unnest(string_split(p_type || '|' || p_brand, '|')) AS tag FROM part) SELECT tag, count(*) AS n FROM t GROUP BY ALL")
def inventory_tags(spark, sf_dir):
    """Counts by the parts of a list in one column."""
    tags = F.split(F.concat("p_type", F.lit("|"), "p_brand"), r"\|")
    return table(spark, sf_dir, "part").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE position('|' || 'Brand#11' || '|' IN '|' || p_type || '|' || p_brand || '|') > 0")
def composite_match(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.array_contains(F.split(F.concat("p_type", F.lit("|"), "p_brand"), r"\|"), "Brand#11")).select("p_partkey")


@query("WITH d(region, declared) AS (VALUES (0, 5), (1, 5), (2, 4), (9, 1)), a AS (SELECT n_regionkey AS region, count(*) AS actual FROM nation GROUP BY ALL) SELECT coalesce(d.region, a.region) AS region, declared, actual FROM d FULL JOIN a ON d.region = a.region WHERE declared IS DISTINCT FROM actual")
def declared_counts(spark, sf_dir):
    declared = spark.createDataFrame([(0, 5), (1, 5), (2, 4), (9, 1)], "region int, declared long").withColumn("n", F.col("declared"))
    actual = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.lit(1).cast("long").alias("n"))
    return checks.unequal_totals(declared, actual, ["region"], "n").select("region", F.col("left_value").alias("declared"), F.col("right_value").alias("actual"))


@query("SELECT p_brand, p_size % 5 AS k, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 3")
def count_by(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).alias("k")).agg(F.count("*").alias("n")).filter("n > 3")


@query("WITH a AS (SELECT p_brand AS name, CASE WHEN p_size % 2 = 0 THEN 'pref' ELSE 'national' END AS scope, 2000 + p_size % 20 AS year, CASE p_partkey % 4 WHEN 0 THEN 'CR' WHEN 1 THEN 'EN' WHEN 2 THEN 'VU' ELSE 'NT' END AS category FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name, scope ORDER BY year DESC, list_position(['CR', 'EN', 'VU', 'NT'], category), category) AS rn FROM a), t AS (SELECT DISTINCT name FROM a UNION SELECT 'none') SELECT t.name, coalesce(p.category, n.category) AS category, CASE WHEN p.category IS NOT NULL THEN 'pref_exact' WHEN n.category IS NOT NULL THEN 'national_exact' END AS method FROM t LEFT JOIN r p ON p.name = t.name AND p.scope = 'pref' AND p.rn = 1 LEFT JOIN r n ON n.name = t.name AND n.scope = 'national' AND n.rn = 1")
def redlist_fill(spark, sf_dir):
    k = F.col("p_partkey") % 4
    category = F.when(k == 0, "CR").when(k == 1, "EN").when(k == 2, "VU").otherwise("NT")
    lists = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "pref").otherwise("national").alias("scope"), (2000 + F.col("p_size") % 20).alias("year"), category.alias("category"))
    taxa = lists.select("name").distinct().union(spark.createDataFrame([("none",)], "name string"))
    return registry.red_list(taxa, lists, ["CR", "EN", "VU", "NT"])


@query("WITH c AS (SELECT s_nationkey AS zone, s_suppkey AS source, s_acctbal AS share FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY share DESC NULLS LAST, source) AS rn FROM c) SELECT zone, source, share FROM r WHERE rn = 1")
def greatest_share(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("share"))
    return documents.greatest_share(rows, ["zone"], "share", "source")


_FEATURES = "SELECT 'Feature' AS type, c_custkey AS id, CAST(floor(c_acctbal / 100) AS BIGINT) AS gx, CAST(c_custkey % 100 AS BIGINT) AS gy, 5 AS corners FROM customer"


@query(_FEATURES)
def mesh_features(spark, sf_dir):
    return _features(table(spark, sf_dir, "customer"))


def _features(customers):
    """Cells as closed squares; their JSON is read back to show that it holds what went in."""
    from shizuku.sources.files import to_geojson

    x, y = F.floor(F.col("c_acctbal") / 100), F.col("c_custkey") % 100
    ring = naming.square(y.cast("double"), x.cast("double"), 1.0)
    rows = customers.select(F.col("c_custkey").alias("id"), x.alias("gx"), y.alias("gy"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    back = F.from_json("feature", "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<id: long, gx: long, gy: long>")
    read = to_geojson(rows, "geometry", ["id", "gx", "gy"]).select(back.alias("f"))
    return read.select("f.type", "f.properties.id", "f.properties.gx", "f.properties.gy", F.size(F.col("f.geometry.coordinates")[0]).alias("corners"))


@query("WITH m AS (SELECT s_suppkey AS old_id, 1000000 + s_suppkey AS new_id FROM supplier WHERE s_suppkey % 2 = 0) SELECT coalesce(new_id, l_suppkey) AS id, count(*) AS n FROM lineitem LEFT JOIN m ON l_suppkey = old_id GROUP BY ALL")
def mapped_ids(spark, sf_dir):
    id_map = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old_id"), (1000000 + F.col("s_suppkey")).alias("new_id"))
    # Rows of one id are counted first, so that the map meets each id once.
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return sampling.mapped_ids(rows, id_map, "id").groupBy("id").agg(F.sum("n").alias("n"))


@query("WITH r AS (SELECT s_suppkey AS place, 'ref' || s_nationkey AS ref, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS rn FROM supplier) SELECT n_nationkey, place, ref FROM nation LEFT JOIN r ON ref = 'ref' || n_nationkey AND rn = 1")
def latest_ref(spark, sf_dir):
    """A scalar subquery per row, as one ranked join."""
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.concat(F.lit("ref"), "s_nationkey").alias("ref"))
    newest = registry.latest(refs, ["ref"], [F.desc("place")])
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("ref"), "n_nationkey").alias("want"))
    return nations.join(newest, F.col("want") == F.col("ref"), "left").select("n_nationkey", "place", "ref")


@query("SELECT DISTINCT n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 3")
def union_all(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.filter("n_regionkey = 1").select("n_nationkey").distinct().unionAll(n.filter("n_nationkey < 3").select("n_nationkey"))


@query("WITH s AS (SELECT event_type AS source, strftime(max(ts), '%Y-%m-%d') AS fetched FROM events GROUP BY ALL) SELECT source, fetched, date_diff('day', CAST(fetched AS DATE), DATE '2024-06-01') AS age_days FROM s")
def source_age(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("fetched"))
    return rows.withColumn("age_days", F.datediff(F.lit("2024-06-01").cast("date"), F.to_date("fetched")).cast("long"))


@query("WITH n AS (SELECT c_nationkey AS zone, c_mktsegment AS class, count(*) AS n_cells, CAST(sum(floor(c_acctbal)) AS BIGINT) AS area FROM customer GROUP BY ALL) SELECT zone, class, n_cells, area, round(n_cells * 100.0 / sum(n_cells) OVER (PARTITION BY zone), 4) AS pct FROM n")
def landuse_mesh(spark, sf_dir):
    """Cells and areas by zone and class, with the class's share of the zone."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n_cells"), F.sum(F.floor("c_acctbal")).alias("area"))
    return rows.withColumn("pct", F.round(F.col("n_cells") * 100.0 / F.sum("n_cells").over(Window.partitionBy("zone")), 4))


# Land use: customers as cells of a mesh, their segments as classes, bands of longitude as watersheds.


def _mesh_cells(spark, sf_dir):
    k = F.col("c_custkey")
    iy, ix = (k * 7 % 800).cast("int"), (k * 13 % 640).cast("int")
    digits = [(iy / 100), (ix / 100), (iy / 10 % 10), (ix / 10 % 10), (iy % 10), (ix % 10)]
    code = F.concat(F.lit("5339"), *(d.cast("int").cast("string") for d in digits))
    return table(spark, sf_dir, "customer").select(mesh.cell_of(code).alias("c"), F.col("c_mktsegment").alias("kind")).select("c.ix", "c.iy", "kind")


_CELLS = "c AS (SELECT 139 * 800 + c_custkey * 13 % 640 AS ix, 53 * 800 + c_custkey * 7 % 800 AS iy, c_mktsegment AS kind FROM customer)"
_UPTO = "(sin(radians({0} / 1200.0)) / (1 - pow({1}, 2) * pow(sin(radians({0} / 1200.0)), 2)) + ln((1 + {1} * sin(radians({0} / 1200.0))) / (1 - {1} * sin(radians({0} / 1200.0)))) / (2 * {1}))"
_ECC = "sqrt(1 - pow(6356752.314245179 / 6378137.0, 2))"


@query(f"""WITH {_CELLS}, a AS (SELECT *, (ix + 0.5) / 800 AS lon, radians(1 / 800.0) * pow(6356752.314245179, 2) / 2 * ({_UPTO.format("(iy + 1)", _ECC)} - {_UPTO.format("iy", _ECC)}) AS m2 FROM c)
SELECT CASE WHEN lon < 139.2001 THEN 'ws:1' WHEN lon < 139.5001 THEN 'ws:2' END AS polygon_id, kind, count(*) AS n_cells, round(sum(m2)) AS m2 FROM a GROUP BY ALL""")
def landuse_areas(spark, sf_dir):
    """Cells and square metres on the ellipsoid by watershed and class; what lies east of all watersheds has none."""
    ring = lambda x1, x2: [[x1, 35.0], [x2, 35.0], [x2, 36.5], [x1, 36.5]]
    polygons = spark.createDataFrame([("ws:1", [ring(138.9, 139.2001)]), ("ws:2", [ring(139.2001, 139.5001)])], "polygon_id string, rings array<array<array<double>>>")
    return mesh.areas(_mesh_cells(spark, sf_dir), polygons).withColumn("m2", F.round("m2"))


@query(f"""WITH {_CELLS}, d AS (SELECT DISTINCT * FROM c), n AS (SELECT kind, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT a.kind, count(*) AS pairs FROM d a JOIN d b ON a.kind = b.kind AND ((b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1)) GROUP BY ALL)
SELECT kind, CAST(4 * n - 2 * coalesce(pairs, 0) AS BIGINT) AS border, n AS area FROM n LEFT JOIN p USING (kind)""")
def landuse_outlines(spark, sf_dir):
    """Length of the outlines of each class, holes included, and the area they hold, in sides and cells: that of the cells."""
    pairs = F.arrays_zip(F.col("corners").alias("a"), F.concat(F.slice("corners", 2, F.size("corners")), F.slice("corners", 1, 1)).alias("b"))
    length = F.aggregate("p", F.lit(0).cast("long"), lambda s, q: s + F.abs(q["a"]["x"] - q["b"]["x"]) + F.abs(q["a"]["y"] - q["b"]["y"]))
    twice = F.aggregate("p", F.lit(0).cast("long"), lambda s, q: s + q["a"]["x"].cast("long") * q["b"]["y"] - q["b"]["x"].cast("long") * q["a"]["y"])
    rings = mesh.outlines(_mesh_cells(spark, sf_dir), ["kind"]).withColumn("p", pairs)
    return rings.groupBy("kind").agg(F.sum(length).alias("border"), (F.sum(twice) / 2).cast("long").alias("area"))
