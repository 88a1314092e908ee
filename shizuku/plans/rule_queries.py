"""Queries that apply the scalar rules, readers, writers, adapters and checks to whole tables, each with its SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from shizuku.functions import naming, periods
from shizuku.operators import checks, facts, observation_cube, occurrence_cube, sampling, series, snapshots, temporal
from shizuku.plans.domain import DAYS, DIM, MONTHS, OBS, OCC, monthly, observation, occurrence, occurrence_cells, query, table
from shizuku.plans.observation_queries import _PICK, _UNFOLD, _YEARS, days_of, years_of
from shizuku.sources import adapters, files, parted, tables
from shizuku.sources.stored import scratch_dir


def _place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/shizuku-files/{name}-{uuid.uuid4().hex}"


# Periods.


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') END AS period_start,
CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-12-31') WHEN 1 THEN strftime(last_day(o_orderdate), '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS period_end FROM orders""")
def label_periods(spark, sf_dir):
    """Labels of 4, 7, 10 and 25 characters; the last are ends of hours in local time."""
    k = F.col("o_orderkey") % 4
    label = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00+09:00")))
    grain = F.when(k == 0, "year").when(k == 1, "month").when(k == 2, "day").otherwise("hour")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", periods.label_period(label, grain).alias("p"))
    return rows.select("o_orderkey", "p.period_start", "p.period_end")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS fiscal_year, o_orderkey % 5 <> 0 AS agrees FROM orders")
def era_labels(spark, sf_dir):
    """Years and months from labels in an era's years, checked against a year of the common era beside them, which every fifth row has wrong."""
    year = F.year("o_orderdate")
    label = F.concat(F.lit("平成"), (year - 1988).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "年度").otherwise("年"), F.month("o_orderdate").cast("string"), F.lit("月"))
    beside = F.concat((year + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("年"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), beside.alias("beside"))
    return rows.select("o_orderkey", periods.era_year(F.col("label")).alias("year"), periods.era_month(F.col("label")).alias("month"), periods.era_fiscal_year(F.col("label")).alias("fiscal_year"), (periods.era_year(F.col("label")) == periods.era_year(F.col("beside"))).alias("agrees"))


# Names, keys and numbers.


@query("SELECT p_partkey, 'Genus ' || lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || ' minor' AS bare, CAST(p_size AS DOUBLE) * 1000 AS number, CAST(p_size AS BIGINT) AS count, CAST(p_partkey % 10 AS BIGINT) AS inner_count, trim(split_part(p_type, ' ', -1)) AS label FROM part")
def names_and_numbers(spark, sf_dir):
    """Scientific names without subgenus and rank marks, numbers in full-width digits, counts with an inner count, labels of row keys."""
    epithet = F.lower(F.regexp_replace("p_brand", "[^A-Za-z]", ""))
    name = F.concat(F.lit("Genus (Subgenus) "), epithet, F.lit(" var. minor"))
    wide = F.translate(F.concat(F.col("p_size").cast("string"), F.lit(",000")), "0123456789,", "０１２３４５６７８９，")
    pair = naming.count_pair(F.translate(F.concat(F.col("p_size").cast("string"), F.lit("（"), (F.col("p_partkey") % 10).cast("string"), F.lit("）")), "0123456789", "０１２３４５６７８９"))
    label = naming.row_label(F.concat(F.lit("total|"), F.regexp_replace("p_type", " ", "|")))
    return table(spark, sf_dir, "part").select("p_partkey", naming.bare_name(name).alias("bare"), naming.number_of(wide).alias("number"), pair["count"].alias("count"), pair["inner"].alias("inner_count"), label.alias("label"))


@query("SELECT c_custkey, 'grid01:' || CAST(floor(c_acctbal / 100 * 100) AS BIGINT) || ',' || CAST(c_custkey % 180 * 100 AS BIGINT) AS cell, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 180 AS DOUBLE) AS lon, 'a%20' || CAST(c_custkey AS VARCHAR) || '%2F.-_%E7%A8%AE' AS escaped, CASE c_custkey % 3 WHEN 0 THEN 'estimated' WHEN 1 THEN 'unknown' ELSE 'unknown' END AS weakest, c_custkey % 3 = 0 AND c_acctbal >= 10000 / 3 AS withheld FROM customer")
def cells_and_ids(spark, sf_dir):
    """Grid cells of coordinates and back, reversible ids, and the weaker of two bases."""
    k = F.col("c_custkey")
    back = naming.grid_of_place(F.concat(F.lit("common:place:grid01."), (k % 90 * 100).cast("string"), F.lit("_"), (k % 180 * 100).cast("string")))
    other = F.when(k % 3 == 0, "estimated").when(k % 3 == 1, "unknown")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", naming.grid_id(F.col("c_acctbal") / 100, (k % 180).cast("double")).alias("cell"), back["lat"].alias("lat"), back["lon"].alias("lon"),
        naming.escaped_id(F.concat(F.lit("a "), k.cast("string"), F.lit("/.-_種"))).alias("escaped"), naming.weakest(["measured", "published", "derived", "estimated", "assumed", "unknown"], F.lit("derived"), other).alias("weakest"), naming.withheld(F.when(k % 3 == 0, F.col("c_acctbal") * 3)).alias("withheld"),
    )


@query("""SELECT p_partkey, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 0.01 END::DOUBLE, 6) AS hectares, p_size * CASE p_partkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1000000.0 ELSE 100000000.0 END::DOUBLE AS yen,
CASE p_partkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'noncommercial' WHEN 2 THEN 'restricted' WHEN 5 THEN 'open' WHEN 6 THEN 'restricted' WHEN 7 THEN 'noncommercial' ELSE 'unknown' END AS license_class, power(10.0::DOUBLE, 5 - p_partkey % 6) AS uncertainty_m FROM part""")
def units_and_licenses(spark, sf_dir):
    k = F.col("p_partkey")
    area = F.when(k % 4 == 0, "ha").when(k % 4 == 1, "平方キロメートル").when(k % 4 == 2, "a").otherwise("坪")
    money = F.when(k % 3 == 0, "千円").when(k % 3 == 1, "百万円").otherwise("億円")
    base = "https://creativecommons.org/licenses"
    text = F.when(k % 8 == 0, "CC0").when(k % 8 == 1, f"{base}/by-nc/4.0/legalcode").when(k % 8 == 2, "cc-by-sa").when(k % 8 == 3, "All rights reserved").when(k % 8 == 5, f"{base}/by/4.0/legalcode").when(k % 8 == 6, f"{base}/by-sa/4.0/legalcode").when(k % 8 == 7, "cc-by-nc-nd")
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(naming.in_unit(size, area, naming.HECTARES), 6).alias("hectares"), naming.in_unit(size, money, naming.YEN).alias("yen"), naming.license_class(text).alias("license_class"), naming.coordinate_uncertainty((k % 6).cast("int")).alias("uncertainty_m"))


@query("WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS value FROM customer), m AS (SELECT *, TRY_CAST(value AS DOUBLE) AS number FROM v) SELECT c_custkey, value, row_number() OVER (ORDER BY number IS NULL, number, value) AS place FROM m ORDER BY place LIMIT 1000")
def mixed_sort(spark, sf_dir):
    """The first thousand of values of which some are numbers, with their place: numbers by value before all texts."""
    from pyspark.sql import Window

    value = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"))
    top = rows.orderBy(naming.mixed_order(F.col("value"))).limit(1000)  # the feature: a page of a sorted list
    return top.withColumn("place", F.row_number().over(Window.orderBy(naming.mixed_order(F.col("value")))).cast("long"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE 'site ' || s_suppkey END AS label, CASE WHEN s_suppkey % 5 = 0 THEN 'new' WHEN s_suppkey % 7 = 0 THEN 'same' WHEN s_suppkey % 4 < s_suppkey % 3 THEN 'up' WHEN s_suppkey % 4 > s_suppkey % 3 THEN 'down' ELSE 'same' END AS direction FROM supplier")
def labels_and_moves(spark, sf_dir):
    k = F.col("s_suppkey")
    before, now = F.when(k % 5 != 0, k % 3), F.when(k % 7 != 0, k % 4)
    return table(spark, sf_dir, "supplier").select("s_suppkey", naming.picked_label(F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise("  "), F.concat(F.lit("site "), k.cast("string"))).alias("label"), naming.direction(before, now).alias("direction"))


# Cubes and cells.


@query(f"""WITH {DAYS}, u AS (SELECT 'day' AS grain, stat, n, n_censored, n_not_detected, value_zero FROM (SELECT *, {_PICK} FROM days {_UNFOLD})
UNION ALL SELECT 'day', 'sum', n, n_censored, n_not_detected, vz_sum FROM days WHERE variable_id IN ('R', 'N') AND (obs_stat IS NULL OR obs_stat = 'sum')
UNION ALL SELECT 'month', 'mean', count(*), CAST(sum(n_censored) AS BIGINT), CAST(sum(n_not_detected) AS BIGINT), avg(vz_mean) FROM days GROUP BY {DIM}, input_grain, substr(period_start, 1, 7)
UNION ALL SELECT 'year', stat, n, n_censored, n_not_detected, value_zero FROM (SELECT *, {_PICK} FROM (SELECT avg(vz_mean) AS vz_mean, min(vz_mean) AS vz_min, max(vz_mean) AS vz_max, avg(vl_mean) AS vl_mean, min(vl_mean) AS vl_min, max(vl_mean) AS vl_max, count(*) AS n, CAST(sum(n_censored) AS BIGINT) AS n_censored, CAST(sum(n_not_detected) AS BIGINT) AS n_not_detected FROM days GROUP BY {DIM}, input_grain, substr(period_start, 1, 4)) {_UNFOLD}))
SELECT grain, stat, count(*) AS cells, count(value_zero) AS with_value, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_censored) AS BIGINT) AS n_censored, CAST(sum(n_not_detected) AS BIGINT) AS n_not_detected FROM u GROUP BY ALL""")
def cube_families(spark, sf_dir):
    """All families of the observation cube, by grain and statistic."""
    variables = spark.createDataFrame([("A", "mean"), ("N", "sum"), ("R", "sum")], "variable_id string, default_stat string")
    cells = observation_cube.cube(observation(spark, sf_dir), variables)
    return cells.groupBy("grain", "stat").agg(F.count("*").alias("cells"), F.count("value_zero").alias("with_value"), F.sum("n").alias("n"), F.sum("n_censored").alias("n_censored"), F.sum("n_not_detected").alias("n_not_detected"))


@query(f"WITH {OCC} SELECT count(*) FILTER (WHERE grain NOT IN ('year', 'survey_period', 'month')) AS other_grain, count(*) FILTER (WHERE grain = 'year' AND (period_start <> substr(period_start, 1, 4) || '-01-01' OR period_end <> substr(period_start, 1, 4) || '-12-31')) AS not_a_year, count(*) FILTER (WHERE grain = 'survey_period' AND substr(period_start, 1, 4) = substr(period_end, 1, 4)) AS within_a_year, count(*) FILTER (WHERE grain = 'month' AND (substr(period_start, 9, 2) <> '01' OR period_end <> strftime(last_day(CAST(period_start AS DATE)), '%Y-%m-%d'))) AS not_a_month FROM agg")
def cell_shapes(spark, sf_dir):
    return checks.misshapen_cells(occurrence_cells(spark, sf_dir, ("year", "survey_period", "month")), ["year", "survey_period", "month"])


@query(f"""WITH {MONTHS}, w AS (SELECT {DIM}, CAST(substr(period_start, 1, 4) AS INTEGER) - CASE WHEN CAST(substr(period_start, 6, 2) AS INTEGER) < 4 THEN 1 ELSE 0 END AS y, count(*) AS n, min(v_zero) AS lo, max(v_zero) AS hi FROM mem WHERE period_grain = 'month' AND value_grain <> 'month' GROUP BY ALL)
SELECT {DIM}, CAST(y AS VARCHAR) AS bucket, stat, n AS n_months FROM w CROSS JOIN (SELECT unnest(['min', 'max', 'mean']) AS stat) WHERE y % 2 = 0""")
def months_without_years(spark, sf_dir):
    """Months whose fiscal years are missing: the check against a cube from which every even fiscal year was taken. With all years there it finds nothing."""
    members = observation_cube.imputed(monthly(spark, sf_dir))
    months = observation_cube.source_cells(members, ["month"])
    years = observation_cube.declared_rollup(members, "fiscal_year").filter(F.substring("period_start", 1, 4).cast("int") % 2 == 1)
    bucket = F.lpad(periods.fiscal_year_of(F.col("period_start")).cast("string"), 4, "0")
    found = checks.months_unlike_years(months.unionByName(years), observation_cube.DIMS, bucket)
    return found.select(*observation_cube.DIMS, "bucket", "stat", F.col("months.n").alias("n_months"))


@query(f"WITH {OCC}, here AS (SELECT taxon_id, CASE WHEN record_id % 3 <> 0 THEN 'ws:' || record_id % 7 END AS place_id, period_start, period_end, red_list_category, is_alien_in_scope FROM occ) SELECT taxon_id, place_id, substr(period_start, 1, 4) AS year, count(*) AS n, count(*) FILTER (WHERE red_list_category <> '') AS n_red_list FROM here WHERE substr(period_start, 1, 4) = substr(period_end, 1, 4) GROUP BY ALL")
def bridged_watersheds(spark, sf_dir):
    """Records at the watersheds that a table of places gives them; a record without one counts at none."""
    occ = occurrence(spark, sf_dir)
    watershed = F.when(F.col("record_id") % 3 != 0, F.concat(F.lit("ws:"), (F.col("record_id") % 7).cast("string")))
    places = occ.select("record_id", F.lit("watershed").alias("place_kind"), watershed.alias("place_id")).distinct()
    cells = occurrence_cube.cells(occurrence_cube.watershed(occ, places), "year")
    return cells.groupBy("taxon_id", "place_id", F.substring("period_start", 1, 4).alias("year")).agg(F.sum("n").alias("n"), F.sum("n_red_list").alias("n_red_list"))


@query(f"WITH {_YEARS}, k(variable_id, obs_stat, unit_id) AS (VALUES ('R', 'mean', 'F'), ('A', NULL, 'F'), ('N', 'sum', 'O')) SELECT y.place_id, y.variable_id, y.obs_stat, y.unit_id, y.period_start, y.stat, y.value_zero, y.n FROM years y JOIN k ON y.variable_id = k.variable_id AND y.obs_stat IS NOT DISTINCT FROM k.obs_stat AND y.unit_id = k.unit_id JOIN supplier ON y.place_id = 'site:' || s_suppkey WHERE y.stat IN ('mean', 'max') AND y.period_start >= '1993' AND y.period_start <= '1997' AND s_nationkey IN (1, 2, 3, 4)")
def cells_of_spec(spark, sf_dir):
    """Cells by a specification: series by their whole keys, a scope of zones, bounds of the period compared as texts."""
    within = table(spark, sf_dir, "supplier").select(F.lit("within").alias("relation"), F.concat(F.lit("zone:"), "s_nationkey").alias("parent_id"), F.concat(F.lit("site:"), "s_suppkey").alias("child_id"))
    spec = series.CellSpec(stats=("mean", "max"), series=(("R", "day", "mean", "F"), ("A", "day", None, "F"), ("N", "day", "sum", "O")), scope=("zone", ["zone:1", "zone:2", "zone:3", "zone:4"]), period=("1993", "1997"))
    found = series.of_grain(years_of(spark, sf_dir, lambda rows: series.chosen(rows, spec, {"place_relation": within})), spec)
    return found.select("place_id", "variable_id", "obs_stat", "unit_id", "period_start", "stat", "value_zero", "n")


@query(f"WITH {_YEARS} SELECT place_id, variable_id, obs_stat, unit_id, period_start, value_zero FROM years WHERE stat = 'mean' AND place_id IN ('site:1', 'site:5', 'site:9') AND region_id IS NOT NULL ORDER BY place_id, period_start, stat, variable_id, value_grain, obs_stat NULLS FIRST, unit_id NULLS FIRST LIMIT 51")
def cells_page(spark, sf_dir):
    """The first fifty cells of three places in the fixed order, and one more that tells that there are others."""
    spec = series.CellSpec(scope=("places", ["site:1", "site:5", "site:9"]), limit=50)
    return series.cells(years_of(spark, sf_dir), spec, {"place": table(spark, sf_dir, "supplier")}).select("place_id", "variable_id", "obs_stat", "unit_id", "period_start", "value_zero")


@query(f"WITH {DAYS}, s AS (SELECT period_start, place_id, vz_mean, row_number() OVER (ORDER BY period_start, place_id, obs_stat NULLS FIRST, unit_id) - 1 AS i, count(*) OVER () AS n FROM days WHERE variable_id = 'N'), p AS (SELECT DISTINCT CAST(round(k * (n - 1) / CAST(greatest(least(200, n) - 1, 1) AS DOUBLE)) AS BIGINT) AS i FROM (SELECT DISTINCT n FROM s), range(200) r(k) WHERE k < n) SELECT period_start, place_id, round(vz_mean, 6) AS value FROM s JOIN p USING (i)")
def thinned_series(spark, sf_dir):
    """A long series thinned to 200 values, evenly spaced in order."""
    rows = days_of(spark, sf_dir).filter("variable_id = 'N'").select("period_start", "place_id", F.coalesce("obs_stat", F.lit("")).alias("stat_key"), "unit_id", "vz_mean")
    return series.evenly(rows, ["period_start", "place_id", "stat_key", "unit_id"], 200).select("period_start", "place_id", F.round("vz_mean", 6).alias("value"))


_SCOPED = "binom, max(taxon_group) AS taxon_group, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_red_list) AS BIGINT) AS n_red_list, count(DISTINCT place_id) AS n_places, min(year) AS y_from, max(year) AS y_to FROM cells WHERE place_kind = 'watershed' AND binom IS NOT NULL"


@query(f"WITH {OCC} SELECT {_SCOPED} AND source_id IN ('1-URGENT', '2-HIGH') AND place_id IN ('ws:1', 'ws:2', 'ws:3', 'ws:7') AND year BETWEEN 1993 AND 1996 GROUP BY binom HAVING max(taxon_group) = 'Small' AND sum(n_red_list) > 0")
def scoped_species(spark, sf_dir):
    """The species catalog of some watersheds, years and sources: red-listed species of one group."""
    cells = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed'")
    return occurrence_cube.scoped_species(cells, ["ws:1", "ws:2", "ws:3", "ws:7"], (1993, 1996), ["1-URGENT", "2-HIGH"], "Small", True)


@query(f"WITH {OCC} SELECT 'all' AS scope, count(DISTINCT binom) AS n_species, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE place_kind = 'watershed' AND binom IS NOT NULL UNION ALL SELECT 'none', 0, NULL")
def source_scopes(spark, sf_dir):
    """No list of sources stands for all of them, an empty one for none."""
    cells = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed'")
    total = lambda name, sources: occurrence_cube.scoped_species(cells, sources=sources).agg(F.lit(name).alias("scope"), F.count("*").alias("n_species"), F.sum("n").alias("n"))
    return total("all", None).unionByName(total("none", []))


@query(f"WITH {OCC} SELECT binom, year, source_id, CAST(sum(CASE WHEN place_kind = 'watershed' THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN place_kind = 'grid01' THEN n ELSE 0 END) AS BIGINT) AS n_located, nullif(count(DISTINCT CASE WHEN place_kind = 'grid01' THEN place_id END), 0) AS mesh FROM cells WHERE binom IS NOT NULL GROUP BY ALL HAVING n <> n_located")
def unlocated_years(spark, sf_dir):
    return occurrence_cube.unlocated_years(occurrence_cells(spark, sf_dir))


@query("SELECT 'ws:' || n_nationkey AS watershed_id, n_name AS name, 'region:' || n_regionkey AS region_id, count(s_suppkey) AS n_sites, round(CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS balance, count(s_suppkey) > 0 AS observed FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def watershed_attributes(spark, sf_dir):
    """Every watershed with its attributes and sites, those without any too."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name", "n_regionkey")
    total = F.round(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double"), 2)
    return rows.agg(F.count("s_suppkey").alias("n_sites"), total.alias("balance")).select(F.concat(F.lit("ws:"), "n_nationkey").alias("watershed_id"), F.col("n_name").alias("name"), F.concat(F.lit("region:"), "n_regionkey").alias("region_id"), "n_sites", "balance", (F.col("n_sites") > 0).alias("observed"))


# Files.


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    """Suppliers written as CSV with a byte order mark, as JSON lines, and read back; rows that differ would be missing."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long"), F.concat(F.lit('"'), "s_name", F.lit('", 種')).alias("s_name"), F.col("s_nationkey").cast("long"), "s_acctbal")
    kind = "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"
    at = _place(spark, "csv")
    files.write_csv(rows, f"{at}/csv")
    files.write_jsonl(rows, f"{at}/jsonl")
    back = files.read_csv(spark, f"{at}/csv", kind, escape='"').intersect(files.read_jsonl(spark, f"{at}/jsonl", kind))
    return back.select("s_suppkey", F.regexp_extract("s_name", '^"(.*)", 種$', 1).alias("s_name"), "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS polygon_id, 1 AS rings, 5 AS corners, CAST(c_custkey % 100 AS DOUBLE) AS south FROM customer")
def geojson_round_trip(spark, sf_dir):
    """Cells written as a GeoJSON FeatureCollection a file and read back."""
    x, y = F.floor(F.col("c_acctbal") / 100).cast("double"), (F.col("c_custkey") % 100).cast("double")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(naming.square(y, x, 1.0)).alias("coordinates")).alias("geometry"))
    features = files.to_geojson(rows, "geometry", ["id"])
    groups = features.groupBy(F.pmod(F.xxhash64("feature"), F.lit(16)).alias("g")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    at = _place(spark, "geojson")
    groups.select("g", "value").write.partitionBy("g").text(at)
    back = files.read_geojson(spark, f"{at}/*/*.txt", "id")
    return back.select("polygon_id", F.size("rings").alias("rings"), F.size(F.col("rings")[0]).alias("corners"), F.col("rings")[0][0][1].alias("south"))


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def published_table(spark, sf_dir):
    """Orders published twice, partitioned and sorted, the second time after a check, and read back: what was published last counts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    at = _place(spark, "published")
    tables.publish(orders, at, partition_by=["o_orderstatus"], sort_by=["o_orderkey"])
    tables.publish(orders.filter("o_orderstatus <> 'P'"), at, [lambda df: checks.guard("keys", checks.repeated_keys(df, ["o_orderkey"]))], ["o_orderstatus"], ["o_orderkey"])
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2)
    return spark.read.parquet(at).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), total.alias("total"))


@query("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def exported_package(spark, sf_dir):
    """Three tables exported with a manifest; each is read back by the path and the rows that the manifest names."""
    at = _place(spark, "package")
    package = tables.export({t: table(spark, sf_dir, t) for t in ("region", "nation", "supplier")}, at, {"supplier": ["s_nationkey"]})
    rows = [spark.read.parquet(f"{at}/{r['path']}").agg(F.lit(r["name"]).alias("name"), F.count("*").alias("n")).filter(F.col("n") == r["rows"]) for r in package["resources"]]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'closed' ELSE 'CC-BY' END AS license, l_quantity FROM lineitem) SELECT 'event' AS name, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) AS n_events FROM r WHERE license = 'CC-BY' UNION ALL SELECT 'occurrence', count(*), count(DISTINCT l_orderkey) FROM r WHERE license = 'CC-BY' UNION ALL SELECT 'measurement', count(l_quantity), count(DISTINCT CASE WHEN l_quantity IS NOT NULL THEN l_orderkey END) FROM r WHERE license = 'CC-BY' UNION ALL SELECT 'orphans', 0, 0")
def darwin_core_archive(spark, sf_dir):
    """Records under an open licence as a Darwin Core Archive, read back as its descriptor says, with the rows whose event is missing."""
    text = lambda *c: F.concat_ws(":", *c)
    records = table(spark, sf_dir, "lineitem").select(
        text("l_orderkey", "l_linenumber").alias("occurrenceID"), F.col("l_orderkey").cast("string").alias("eventID"), F.col("l_shipdate").cast("string").alias("eventDate"), F.col("l_suppkey").cast("string").alias("locationID"), F.col("l_linestatus").alias("samplingProtocol"),
        F.lit("HumanObservation").alias("basisOfRecord"), F.concat(F.lit("Genus\tspecies"), "l_linenumber").alias("scientificName"), F.lit("present").alias("occurrenceStatus"), F.when(F.col("l_returnflag") == "A", "closed").otherwise("CC-BY").alias("license"),
        text("l_orderkey", "l_linenumber").alias("measurementID"), F.lit("quantity").alias("measurementType"), F.col("l_quantity").alias("measurementValue"), F.lit("1").alias("measurementUnit"),
    )
    at = _place(spark, "archive")
    files.write_darwin_core(files.darwin_core(records, ["CC-BY"]), at)
    archive = files.read_darwin_core(spark, at)
    counted = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("eventID").alias("n_events")) for name, df in archive.items()]
    counted.append(files.orphans(archive).agg(F.lit("orphans").alias("name"), F.count("*").alias("n"), F.count_distinct("eventID").alias("n_events")))
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


# Facts and their lineage.


_FACTS = """f AS (SELECT l_orderkey, l_quantity, CASE WHEN s.s_suppkey IS NULL THEN 1 ELSE 0 END AS no_place, CASE WHEN p.p_partkey IS NULL THEN 1 ELSE 0 END AS no_variable, CASE WHEN l_quantity >= 3 THEN 0 ELSE 1 END AS too_small, n.n_name AS zone
  FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s.s_suppkey LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p.p_partkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey < 3)"""


def _facts(spark, sf_dir):
    suppliers, parts = table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), table(spark, sf_dir, "part").filter("p_size > 5")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    references = [
        facts.Reference("place", suppliers, (("l_suppkey", "s_suppkey"),), (("nation_key", "s_nationkey"),)), facts.Reference("variable", parts, (("l_partkey", "p_partkey"),), (("size", "p_size"),)),
        facts.Reference("zone", table(spark, sf_dir, "nation").filter("n_regionkey < 3"), (("nation_key", "n_nationkey"),), (("zone", "n_name"),), required=False),
    ]
    return rows, facts.resolved(rows, references, [("too small", F.col("l_quantity") >= 3)])


@query(f"WITH {_FACTS} SELECT zone, count(*) AS n, sum(l_quantity) AS quantity FROM f WHERE no_place + no_variable + too_small = 0 GROUP BY ALL")
def facts_by_zone(spark, sf_dir):
    """Line items whose site and variable are registered; the zone may be missing."""
    return facts.accepted(_facts(spark, sf_dir)[1]).groupBy("zone").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"WITH {_FACTS} SELECT * FROM (SELECT 'place' AS reason, sum(no_place)::BIGINT AS n FROM f UNION ALL SELECT 'variable', sum(no_variable)::BIGINT FROM f UNION ALL SELECT 'too small', sum(too_small)::BIGINT FROM f) WHERE n > 0")
def facts_rejected(spark, sf_dir):
    return facts.reasons(_facts(spark, sf_dir)[1])


@query(f"WITH {_FACTS} SELECT (SELECT count(*) FROM lineitem) AS given, count(*) FILTER (WHERE no_place + no_variable + too_small = 0) AS accepted, count(*) FILTER (WHERE no_place + no_variable + too_small > 0) AS rejected, true AS held FROM f")
def facts_conserved(spark, sf_dir):
    """No line item is lost or doubled on its way to the facts."""
    return facts.conserved(*_facts(spark, sf_dir))


@query("SELECT 'sites' AS name, r.read, c.n FROM (SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey) c, (VALUES ('nation'), ('supplier')) r(read) UNION ALL SELECT 'zones', 'nation', count(*) FROM nation WHERE n_regionkey = (SELECT max(r_regionkey) FROM region) UNION ALL SELECT 'zones', 'region', count(*) FROM nation WHERE n_regionkey = (SELECT max(r_regionkey) FROM region)")
def stage_lineage(spark, sf_dir):
    """What two stages read by their plans, one of them in a subquery, and the rows that they published."""
    catalog = tables.Catalog(spark, _place(spark, "catalog"))
    for name in ("nation", "region", "supplier"):
        catalog.verified[name] = tables.publish(table(spark, sf_dir, name), f"{catalog.path}/{name}")

    def zones(c):
        c.read("region").createOrReplaceTempView("lineage_region")
        c.read("nation").createOrReplaceTempView("lineage_nation")
        return spark.sql("SELECT * FROM lineage_nation WHERE n_regionkey = (SELECT max(r_regionkey) FROM lineage_region)")

    catalog.build("sites", lambda c: c.read("supplier").join(c.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).drop("n_comment", "s_comment"))
    catalog.build("zones", zones)
    rows = [(name, read, found["rows"]) for name, found in catalog.lineage.items() for read in found["from"]]
    return spark.createDataFrame(rows, "name string, read string, n long")


# Joins by time.


def _day_number(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


@query("""WITH o AS (SELECT o_custkey % 5 AS subject, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS since, max({'k': o_orderkey, 'rank': CAST(substr(o_orderpriority, 1, 1) AS INTEGER)}) AS v FROM orders GROUP BY ALL),
e AS (SELECT subject, since, lead(since) OVER (PARTITION BY subject ORDER BY since) AS until, v.rank AS rank FROM o), p AS (SELECT l_suppkey % 5 AS subject, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, l_quantity FROM lineitem)
SELECT subject, rank, count(*) AS n, sum(l_quantity) AS quantity, min(day - since) AS least_age, max(day - since) AS greatest_age FROM p JOIN e USING (subject) WHERE day >= since AND (until IS NULL OR day < until) GROUP BY ALL""")
def assessments_in_force(spark, sf_dir):
    """Line items by the assessment that was in force for their subject on the day: each assessment holds until the next one. Five subjects share all rows."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("subject"), _day_number("o_orderdate").alias("since"), F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    points = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("subject"), _day_number("l_shipdate").alias("day"), "l_quantity")
    found = temporal.valid_at(points, temporal.editions(orders, ["subject"], "since"), ["subject"], "day", "since", "until")
    age = F.col("day") - F.col("since")
    return found.groupBy("subject", "rank").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min(age).alias("least_age"), F.max(age).alias("greatest_age"))


@query("""WITH r AS (SELECT user_id % 3 AS g, ts AS since, event_id FROM events WHERE event_type = 'error'), m AS (SELECT l.event_id, max({'since': r.since, 'event_id': r.event_id}) AS b FROM events l JOIN r ON l.user_id % 3 = r.g AND r.since <= l.ts GROUP BY ALL)
SELECT e.event_id, m.b.event_id AS last_error, date_diff('second', m.b.since, e.ts) AS seconds FROM events e LEFT JOIN m USING (event_id)""")
def last_error_before(spark, sf_dir):
    """For every event the last error up to it among users of its group; three groups share all rows."""
    events = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 3)
    errors = events.filter("event_type = 'error'").select("g", F.col("ts").alias("since"), "event_id")
    found = temporal.as_of(events.select("event_id", "g", "ts"), errors, ["g"], "ts", "since")
    whole = lambda c: F.date_trunc("second", c).cast("long")
    return found.select("event_id", F.col("found.event_id").alias("last_error"), (whole(F.col("ts")) - whole(F.col("found.since"))).alias("seconds"))


@query("SELECT 'written' AS name, count(DISTINCT strftime(o_orderdate, '%Y')) FILTER (WHERE strftime(o_orderdate, '%Y') = '1995') AS n FROM orders UNION ALL SELECT 'kept', count(DISTINCT strftime(o_orderdate, '%Y')) FILTER (WHERE strftime(o_orderdate, '%Y') <> '1995') FROM orders UNION ALL SELECT 'rows', count(*) FROM orders UNION ALL SELECT 'shipped', count(*) FILTER (WHERE strftime(o_orderdate, '%Y') = '1995' OR o_orderstatus = 'F') FROM orders")
def changed_parts(spark, sf_dir):
    """Orders in parts by year, then with one year's changed: how many parts were written, how many stayed in their old folders, and what is there then."""
    year = F.date_format("o_orderdate", "yyyy")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", year.alias("year"))
    changed = orders.withColumn("o_orderstatus", F.when(F.col("year") == "1995", "F").otherwise(F.col("o_orderstatus")))
    store = parted.Parted(spark, _place(spark, "orders-in-parts"))
    store.replace(lambda years: orders.filter(F.col("year").isin(years)), "year", parted.marks_of(orders, F.col("year")))
    before = {p["folder"] for p in store.manifest()["parts"].values()}
    written = store.replace(lambda years: changed.filter(F.col("year").isin(years)), "year", parted.marks_of(changed, F.col("year")))
    kept = before & {p["folder"] for p in store.manifest()["parts"].values()}
    counts = store.read().agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("shipped"))
    named = F.array(F.struct(F.lit("written").alias("name"), F.lit(len(written)).cast("long").alias("n")), F.struct(F.lit("kept").alias("name"), F.lit(len(kept)).cast("long").alias("n")), F.struct(F.lit("rows").alias("name"), F.col("rows").alias("n")), F.struct(F.lit("shipped").alias("name"), F.col("shipped").alias("n")))
    return counts.select(F.explode(named).alias("x")).select("x.*")


# Adapters and samples.


#: An adapter: suppliers in credit as sites.
_SUPPLIER_RECORDS = """
def rows(context):
    for row in context.input_rows():
        if row["s_acctbal"] is not None and row["s_acctbal"] > 0:
            yield {"place_id": f"{context.source}:{row['s_suppkey']}", "name": row["s_name"].strip(), "balance": round(row["s_acctbal"], 2)}
"""
_SITES = adapters.Manifest("sites", "region:1", "place_id string, name string, balance double", checks=(("balance", "balance > 0"), ("prefix", "place_id LIKE 'sites:%'")))
#: Another: orders as records with a severity, parsed from the text of the priority. The key is copied as it is.
_ORDER_RECORDS = """
import re
from datetime import date

SHAPE = re.compile(r"(\\d)-([A-Z ]+)")


def rows(context):
    for row in context.input_rows():
        found = SHAPE.match(row["o_orderpriority"] or "")
        day = row["o_orderdate"]
        if found:
            yield {"record": row["o_orderkey"], "severity": int(found[1]), "label": found[2].strip().title(), "observed": date(day.year, day.month, day.day)}
"""


@query("SELECT 'sites:' || s_suppkey AS place_id, s_name AS name, round(s_acctbal, 2) AS balance, 'sites' AS source_id, 'region:1' AS region_id FROM supplier WHERE s_acctbal > 0")
def adapted_sites(spark, sf_dir):
    """Records of an adapter, run on the executors as its manifest declares."""
    return adapters.adapted(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), _SITES, _SUPPLIER_RECORDS)


def _with_manifest(spark, sf_dir, name: str, manifest: adapters.Manifest):
    """A table read by the data source, as its manifest says."""
    inputs = tuple(table(spark, sf_dir, name).inputFiles())
    adapters.register(spark)
    path = _place(spark, "manifest")
    tables.write_text(spark, path, replace(manifest, inputs=inputs).to_json())
    return spark.read.format("shizuku_adapter").option("manifest", path).load()


@query("SELECT o_orderkey AS record, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS severity, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '4' THEN 'Not Specified' ELSE 'Low' END AS label, CAST(o_orderdate AS DATE) AS observed, 'orders' AS source_id, 'region:2' AS region_id FROM orders WHERE o_orderkey > 1000 AND o_orderpriority IS NOT NULL")
def adapter_source(spark, sf_dir):
    """Records of orders through the data source: partitions by row group, a filter on the copied key handed to the reader."""
    schema = "record long, severity int, label string, observed date"
    manifest = adapters.Manifest("orders", "region:2", schema, code=_ORDER_RECORDS, columns=("o_orderkey", "o_orderpriority", "o_orderdate"), copied=(("record", "o_orderkey"),))
    return _with_manifest(spark, sf_dir, "orders", manifest).filter("record > 1000 AND region_id = 'region:2'")


@query("SELECT 'rows' AS name, CAST(-1 AS BIGINT) + 1 AS expected, count(*) AS found FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'dear', 0, count(*) FILTER (WHERE s_acctbal <= 5000) FROM supplier WHERE s_acctbal > 0")
def unmet_expectations(spark, sf_dir):
    """What a manifest expects of the same records and doesn't get: no rows at all, and balances beyond 5000."""
    strict = adapters.Manifest(_SITES.source, _SITES.region, _SITES.schema, 0, (*_SITES.checks, ("dear", "balance > 5000")))
    return adapters.unmet(adapted_sites(spark, sf_dir), strict)


@query(f"WITH {OBS}, f AS (SELECT place_id, variable_id, count(v_zero) AS n, avg(v_zero) AS m FROM mem GROUP BY ALL) SELECT place_id, variable_id FROM f WHERE n > 0 AND CAST(substr(place_id, 6) AS INTEGER) % 10 = 0")
def recomputed_means(spark, sf_dir):
    """Every tenth place has its mean changed; recomputing all means from their facts finds exactly those."""
    facts = observation_cube.imputed(observation(spark, sf_dir)).select("place_id", "variable_id", "v_zero")
    cells = facts.groupBy("place_id", "variable_id").agg(F.avg("v_zero").alias("mean"))
    wrong = F.substring("place_id", 6, 20).cast("int") % 10 == 0
    return sampling.recomputed_means(facts, cells.withColumn("mean", F.when(wrong, F.col("mean") + 1).otherwise(F.col("mean"))), ["place_id", "variable_id"], "v_zero", "mean").select("place_id", "variable_id")


@query("SELECT s_suppkey, coalesce('n' || n_name, CAST(s_nationkey AS VARCHAR)) AS zone FROM supplier LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def renamed_ids(spark, sf_dir):
    """Old ids replaced where the map has new ones."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("zone"))
    ids = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("old_id"), F.concat(F.lit("n"), "n_name").alias("new_id"))
    return sampling.mapped_ids(rows, ids, "zone")


@query("SELECT 'customer' AS name, count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'nation', count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_totalprice > 300000")
def sample_with_references(spark, sf_dir):
    """Dear orders as seeds, with every customer and nation that they refer to."""
    names = ("orders", "customer", "nation")
    rows = {t: table(spark, sf_dir, t) for t in names}
    found = sampling.closure(rows, {"orders": rows["orders"].filter("o_totalprice > 300000")}, [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")])
    parts = [found[t].agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SALES = "SELECT l_returnflag AS f, '{\"l_linestatus\":\"' || l_linestatus || '\",\"year\":' || year(l_shipdate) || '}' AS row_key, CAST(count(*) AS VARCHAR) AS n, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS units FROM lineitem WHERE %s GROUP BY l_returnflag, l_linestatus, year(l_shipdate)"


@query(f"""WITH b AS ({_SALES % "true"}), a AS ({_SALES % "l_returnflag <> 'R' OR l_linenumber < 5"}),
bl AS (SELECT f, row_key, 'n' AS column_name, n AS value FROM b UNION ALL SELECT f, row_key, 'units', units FROM b), al AS (SELECT f, row_key, 'n' AS column_name, n AS value FROM a UNION ALL SELECT f, row_key, 'units', units FROM a)
SELECT 'sales' AS query, '{{"flag":"' || f || '"}}' AS parameters, row_key, CAST(1 AS INTEGER) AS nth, column_name, CASE WHEN bl.value IS NULL THEN 'added' WHEN al.value IS NULL THEN 'removed' ELSE 'changed' END AS kind, bl.value AS before, al.value AS after
FROM bl FULL JOIN al USING (f, row_key, column_name) WHERE bl.value IS DISTINCT FROM al.value""")
def snapshot_changes(spark, sf_dir):
    """Yearly sales for every return flag before and after a rule leaves some of the returned lines out: each cell that changes is named."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", F.year("l_shipdate").alias("year"))

    def sales(flag: str, kept=None):
        rows = lines.filter(F.col("l_returnflag") == flag)
        rows = rows if kept is None else rows.filter(kept)
        return rows.groupBy("l_linestatus", "year").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("units"))

    flags = snapshots.grid({"flag": ["A", "N", "R"]}, 3)
    kept = (F.col("l_returnflag") != "R") | (F.col("l_linenumber") < 5)
    before = snapshots.snapshot("sales", sales, flags, ["l_linestatus", "year"])
    after = snapshots.snapshot("sales", lambda flag: sales(flag, kept), flags, ["l_linestatus", "year"])
    return snapshots.changes(before, after)
