"""Occurrence cube, summary, biota, red-list and watershed queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shizuku.functions import naming
from shizuku.operators import checks, occurrence_cube, registry, summary
from shizuku.plans.domain import OCC, occurrence, occurrence_cells, query, table, taxon
from shizuku.plans.summaries import SPECS

_AGG = "region_id, source_id, place_id, taxon_id, place_kind, grain, period_start, period_end, n, n_red_list, n_alien"


def _population(spark, sf_dir):
    return occurrence_cube.located(occurrence(spark, sf_dir))


@query(f"WITH {OCC} SELECT {_AGG} FROM agg WHERE grain = 'year' AND place_kind = 'grid01'")
def occ_year(spark, sf_dir):
    return occurrence_cube.cells(_population(spark, sf_dir), "year")


@query(f"WITH {OCC} SELECT {_AGG} FROM agg WHERE grain = 'survey_period' AND place_kind = 'grid01'")
def occ_leaf(spark, sf_dir):
    return occurrence_cube.cells(_population(spark, sf_dir), "survey_period")


@query(f"WITH {OCC} SELECT {_AGG} FROM agg WHERE grain = 'month'")
def occ_month(spark, sf_dir):
    return occurrence_cube.cells(_population(spark, sf_dir), "month")


@query(f"WITH {OCC} SELECT {_AGG} FROM agg WHERE grain <> 'month' AND place_kind = 'watershed'")
def occ_watershed(spark, sf_dir):
    """All dated records at their watershed, by a bridge from records to places; records without one keep a null place."""
    occ = occurrence(spark, sf_dir)
    bridge = occ.select("record_id", F.col("ws_id").alias("place_id")).distinct().withColumn("place_kind", F.lit("watershed"))
    rows = occurrence_cube.watershed(occ.drop("ws_id"), bridge)
    return occurrence_cube.cells(rows, "year").unionByName(occurrence_cube.cells(rows, "survey_period"))


@query(f"WITH {OCC}, a AS (SELECT source_id, place_kind, sum(n) AS n FROM agg WHERE grain <> 'month' GROUP BY ALL), b AS (SELECT source_id, place_kind, count(*) AS n FROM pop GROUP BY ALL) SELECT count(*) AS unequal FROM a FULL JOIN b ON a.source_id = b.source_id AND a.place_kind = b.place_kind WHERE a.n IS DISTINCT FROM b.n")
def occ_totals_reconcile(spark, sf_dir):
    here = _population(spark, sf_dir)
    cells = occurrence_cube.cells(here, "year").unionByName(occurrence_cube.cells(here, "survey_period"))
    rows = here.withColumn("n", F.lit(1).cast("long"))
    return checks.unequal_totals(cells, rows, ["source_id", "place_kind"], "n").agg(F.count("*").alias("unequal"))


@query(f"WITH {OCC}, m AS (SELECT source_id, place_id, taxon_id, substr(period_start, 1, 4) AS y, sum(n) AS n FROM agg WHERE grain = 'month' GROUP BY ALL), y AS (SELECT source_id, place_id, taxon_id, substr(period_start, 1, 4) AS y, sum(n) AS n FROM agg WHERE grain = 'year' AND place_kind = 'grid01' GROUP BY ALL) SELECT count(*) AS beyond_year FROM m LEFT JOIN y ON m.source_id = y.source_id AND m.place_id IS NOT DISTINCT FROM y.place_id AND m.taxon_id = y.taxon_id AND m.y = y.y WHERE y.n IS NULL OR m.n > y.n")
def month_within_year(spark, sf_dir):
    """Month cells never hold more than the year cells around them."""
    here = _population(spark, sf_dir)
    year = F.substring("period_start", 1, 4)
    keys = ["source_id", "place_id", "taxon_id", "y"]
    months = occurrence_cube.cells(here, "month").withColumn("y", year).groupBy(*keys).agg(F.sum("n").alias("m_n"))
    years = occurrence_cube.cells(here, "year").withColumn("y", year).groupBy(*keys).agg(F.sum("n").alias("y_n"))
    years = years.select(*(F.col(k).alias(f"y_{k}") for k in keys), "y_n")
    on = naming.all_of([F.col(k).eqNullSafe(F.col(f"y_{k}")) for k in keys])
    return months.join(years, on, "left").filter("y_n IS NULL OR m_n > y_n").agg(F.count("*").alias("beyond_year"))


# Declared summaries.


def _summary(name: str, by_region: bool = False):
    def run(spark, sf_dir):
        spec = SPECS[name]
        cells = occurrence_cells(spark, sf_dir).drop("binom", "taxon_group", "year")
        tables = {"occurrence_agg": cells, "taxon": taxon(spark, sf_dir)}
        summary.check(name, spec, {k: set(v.columns) for k, v in tables.items()})
        return summary.compile_summary(spec, tables, by_region)

    return run


def _register(name: str, sql: str, by_region: bool = False) -> None:
    run = _summary(name.removesuffix("_by_region"), by_region)
    run.__name__ = name
    query(sql)(run)


_SUMS = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_red_list) AS BIGINT) AS n_red_list, CAST(sum(n_alien) AS BIGINT) AS n_alien"
_TAXON = f"taxon_id, {_SUMS}, count(DISTINCT place_id) AS n_places, min(year) AS y_from, max(year) AS y_to, count(DISTINCT year) AS n_years FROM cells WHERE place_kind = 'grid01' GROUP BY ALL"
_register("sum_taxon_catalog", f"WITH {OCC} SELECT {_TAXON}")
_register("sum_taxon_catalog_by_region", f"WITH {OCC} SELECT region_id, {_TAXON}", True)
_register("sum_watershed_occurrence", f"WITH {OCC} SELECT place_id, {_SUMS}, count(DISTINCT taxon_id) AS n_taxa, min(year) AS y_from, max(year) AS y_to FROM cells WHERE place_kind = 'watershed' GROUP BY ALL")
_WS, _GR = "place_kind = 'watershed'", "place_kind = 'grid01'"
_SPECIES = f"binom, max(taxon_group) AS taxon_group, CAST(sum(CASE WHEN {_WS} THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN {_GR} THEN n ELSE 0 END) AS BIGINT) AS n_located, CAST(sum(CASE WHEN {_WS} THEN n_red_list ELSE 0 END) AS BIGINT) AS n_red_list, CAST(sum(CASE WHEN {_WS} THEN n_alien ELSE 0 END) AS BIGINT) AS n_alien, count(DISTINCT CASE WHEN {_GR} THEN place_id END) AS n_places, min(year) AS y_from, max(year) AS y_to, count(DISTINCT year) AS n_years FROM cells WHERE binom IS NOT NULL GROUP BY ALL"
_register("sum_species_catalog", f"WITH {OCC} SELECT {_SPECIES}")
_register("sum_species_catalog_by_region", f"WITH {OCC} SELECT region_id, {_SPECIES}", True)
_EFFORT = f"year, CAST(sum(CASE WHEN {_WS} THEN n ELSE 0 END) AS BIGINT) AS n, count(DISTINCT binom) AS n_binom, count(DISTINCT CASE WHEN {_GR} THEN place_id END) AS n_places FROM cells GROUP BY ALL"
_register("sum_group_year", f"WITH {OCC} SELECT coalesce(taxon_group, '未判定') AS taxon_group, source_id, {_EFFORT}")
_register("sum_effort_year", f"WITH {OCC} SELECT {_EFFORT}")
_register("sum_effort_year_by_region", f"WITH {OCC} SELECT region_id, {_EFFORT}", True)
_BETWEEN = "year BETWEEN 1996 AND 1999"
_register("sum_grid_catalog", f"WITH {OCC} SELECT place_id, CAST(sum(CASE WHEN {_BETWEEN} THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN {_BETWEEN} THEN n_red_list ELSE 0 END) AS BIGINT) AS n_red_list, count(DISTINCT binom) AS n_binom, count(DISTINCT CASE WHEN n_red_list > 0 THEN binom END) AS n_red_binom FROM cells WHERE {_GR} GROUP BY ALL")


@query(f"WITH {OCC}, a AS (SELECT year, count(DISTINCT place_id) FILTER (WHERE {_GR}) AS p, sum(n) AS n FROM cells GROUP BY ALL), r AS (SELECT year, sum(p) AS p, sum(n) AS n FROM (SELECT region_id, year, count(DISTINCT place_id) FILTER (WHERE {_GR}) AS p, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY ALL) SELECT count(*) AS not_folding FROM a FULL JOIN r USING (year) WHERE a.n IS DISTINCT FROM r.n OR a.p > r.p")
def by_region_fold(spark, sf_dir):
    spec = SPECS["sum_effort_year"]
    tables = {"occurrence_agg": occurrence_cells(spark, sf_dir).drop("binom", "taxon_group", "year"), "taxon": taxon(spark, sf_dir)}
    whole, parts = summary.compile_summary(spec, tables), summary.compile_summary(spec, tables, True)
    return summary.folds_back(whole, parts, spec).agg(F.count("*").alias("not_folding"))


@query(f"WITH {OCC} SELECT DISTINCT place_id, region_id FROM cells WHERE place_kind = 'watershed' AND place_id IS NOT NULL UNION SELECT 'site:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation")
def place_region(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region = F.concat(F.lit("region:"), "n_regionkey").alias("region_id")
    cells = occurrence(spark, sf_dir).filter("ws_id IS NOT NULL").select(F.col("ws_id").alias("place_id"), "region_id")
    sites = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("site:"), "s_suppkey").alias("place_id"), region)
    zones = nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("place_id"), region)
    return cells.union(sites).union(zones).distinct()


@query(f"WITH {OCC} SELECT region_id, taxon_id, red_list_category, count(*) AS n FROM occ WHERE red_list_category <> '' GROUP BY ALL")
def taxon_red_list(spark, sf_dir):
    return occurrence(spark, sf_dir).filter("red_list_category <> ''").groupBy("region_id", "taxon_id", "red_list_category").agg(F.count("*").alias("n"))


# Biota.


@query(f"WITH {OCC} SELECT binom, year, CAST(sum(CASE WHEN {_WS} THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN {_GR} THEN n ELSE 0 END) AS BIGINT) AS n_located, nullif(count(DISTINCT CASE WHEN {_GR} THEN place_id END), 0) AS mesh FROM cells WHERE binom IS NOT NULL GROUP BY ALL")
def species_years_coverage(spark, sf_dir):
    """Records of a species by year next to those with coordinates; meshes are counted over all sources, null without any."""
    here, there = F.col("place_kind") == "grid01", F.col("place_kind") == "watershed"
    mesh = F.countDistinct(F.when(here, F.col("place_id")))
    rows = occurrence_cells(spark, sf_dir).filter("binom IS NOT NULL").groupBy("binom", "year")
    return rows.agg(F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n_located"), F.nullif(mesh, F.lit(0)).alias("mesh"))


_GATE = f"gate AS (SELECT binom FROM cells WHERE {_GR} GROUP BY binom HAVING sum(n) >= 80)"


def _gated(cells):
    return cells.filter("place_kind = 'grid01'").groupBy("binom").agg(F.sum("n").alias("s")).filter("s >= 80").select("binom")


@query(f"WITH {OCC}, {_GATE} SELECT binom, CAST(substr(a.period_start, 6, 2) AS INTEGER) AS month, CAST(sum(n) AS BIGINT) AS n FROM agg a JOIN tax USING (taxon_id) WHERE grain = 'month' AND a.period_start >= '1995-01-01' AND binom IN (SELECT binom FROM gate) GROUP BY ALL")
def species_months_gated(spark, sf_dir):
    cells = occurrence_cells(spark, sf_dir, ("year", "survey_period", "month"))
    months = cells.filter("grain = 'month' AND period_start >= '1995-01-01'")
    return months.join(_gated(cells.filter("grain <> 'month'")), "binom", "left_semi").groupBy("binom", F.substring("period_start", 6, 2).cast("int").alias("month")).agg(F.sum("n").alias("n"))


@query(f"WITH {OCC}, {_GATE} SELECT binom, place_id, year, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE {_GR} AND year = 1995 AND binom IN (SELECT binom FROM gate) GROUP BY ALL")
def species_mesh_years(spark, sf_dir):
    cells = occurrence_cells(spark, sf_dir)
    return cells.filter("place_kind = 'grid01' AND year = 1995").join(_gated(cells), "binom", "left_semi").groupBy("binom", "place_id", "year").agg(F.sum("n").alias("n"))


_SHARE = f"s AS (SELECT coalesce(taxon_group, '未判定') AS grp, binom, CAST(sum(CASE WHEN year < 1998 THEN n ELSE 0 END) AS BIGINT) AS n_a, CAST(sum(CASE WHEN year >= 1998 THEN n ELSE 0 END) AS BIGINT) AS n_b FROM cells WHERE {_WS} GROUP BY ALL), t AS (SELECT *, CAST(sum(n_a) OVER (PARTITION BY grp) AS BIGINT) AS total_a, CAST(sum(n_b) OVER (PARTITION BY grp) AS BIGINT) AS total_b FROM s)"


def _share(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed'").groupBy(F.coalesce("taxon_group", F.lit("未判定")).alias("grp"), "binom")
    rows = rows.agg(F.sum(F.when(F.col("year") < 1998, F.col("n")).otherwise(0)).alias("n_a"), F.sum(F.when(F.col("year") >= 1998, F.col("n")).otherwise(0)).alias("n_b"))
    totals = rows.groupBy("grp").agg(F.sum("n_a").alias("total_a"), F.sum("n_b").alias("total_b"))
    return rows.join(totals, "grp")


@query(f"WITH {OCC}, {_SHARE} SELECT * FROM t WHERE n_a >= 40 AND n_b >= 20")
def share_trend(spark, sf_dir):
    """Two periods of each species with the totals of its whole group, before small species are cut."""
    return _share(spark, sf_dir).filter("n_a >= 40 AND n_b >= 20")


@query(f"WITH {OCC}, {_SHARE} SELECT grp, binom, round(n_a * 1000.0 / total_a, 6) AS pa, round(n_b * 1000.0 / total_b, 6) AS pb, round((n_b * 1000.0 / total_b) / (n_a * 1000.0 / total_a), 6) AS ratio FROM t WHERE n_a > 0 AND n_b > 0")
def share_permille_ratio(spark, sf_dir):
    pa, pb = F.col("n_a") * 1000.0 / F.col("total_a"), F.col("n_b") * 1000.0 / F.col("total_b")
    return _share(spark, sf_dir).filter("n_a > 0 AND n_b > 0").select("grp", "binom", F.round(pa, 6).alias("pa"), F.round(pb, 6).alias("pb"), F.round(pb / pa, 6).alias("ratio"))


@query(f"WITH {OCC}, e AS (SELECT year, count(DISTINCT place_id) AS cells_all FROM cells WHERE {_GR} GROUP BY ALL) SELECT binom, c.year, round(count(DISTINCT place_id) * 100.0 / any_value(cells_all), 6) AS occupancy FROM cells c JOIN e ON c.year = e.year WHERE {_GR} AND binom IS NOT NULL AND c.year >= 1993 GROUP BY binom, c.year")
def occupancy(spark, sf_dir):
    here = occurrence_cells(spark, sf_dir).filter("place_kind = 'grid01'")
    effort = here.groupBy("year").agg(F.countDistinct("place_id").alias("cells_all"))
    mine = here.filter("binom IS NOT NULL AND year >= 1993").groupBy("binom", "year").agg(F.countDistinct("place_id").alias("c"))
    return mine.join(effort, "year").select("binom", "year", F.round(F.col("c") * 100.0 / F.col("cells_all"), 6).alias("occupancy"))


@query(f"WITH {OCC} SELECT place_id, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT binom) AS n_binom, CAST(sum(n_red_list) AS BIGINT) AS n_red_list FROM cells WHERE {_GR} AND year = 1996 GROUP BY ALL")
def mesh_by_year(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'grid01' AND year = 1996").groupBy("place_id")
    return rows.agg(F.sum("n").alias("n"), F.countDistinct("binom").alias("n_binom"), F.sum("n_red_list").alias("n_red_list"))


@query(f"WITH {OCC} SELECT place_id, year, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT taxon_id) AS n_taxa FROM cells WHERE {_WS} AND place_id IS NOT NULL GROUP BY ALL")
def watershed_years(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed' AND place_id IS NOT NULL").groupBy("place_id", "year")
    return rows.agg(F.sum("n").alias("n"), F.countDistinct("taxon_id").alias("n_taxa"))


@query(f"WITH {OCC} SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN place_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS outside, count(DISTINCT place_id) AS n_places, count(DISTINCT binom) AS n_binom FROM cells WHERE {_WS}")
def biota_totals(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed'")
    return rows.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("place_id").isNull(), F.col("n")).otherwise(0)).alias("outside"), F.countDistinct("place_id").alias("n_places"), F.countDistinct("binom").alias("n_binom"))


@query(f"WITH {OCC} SELECT binom, CAST(sum(n_alien) AS BIGINT) AS n_alien, CAST(sum(CASE WHEN year >= 1999 THEN n_alien ELSE 0 END) AS BIGINT) AS n_since, max(year) AS last_year FROM cells WHERE {_WS} AND binom IS NOT NULL GROUP BY binom HAVING sum(n_alien) > 0")
def ias_since(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed' AND binom IS NOT NULL").groupBy("binom")
    return rows.agg(F.sum("n_alien").alias("n_alien"), F.sum(F.when(F.col("year") >= 1999, F.col("n_alien")).otherwise(0)).alias("n_since"), F.max("year").alias("last_year")).filter("n_alien > 0")


@query(f"WITH {OCC}, g AS (SELECT year, coalesce(taxon_group, '未判定') AS taxon_group, source_id, sum(CASE WHEN {_WS} THEN n ELSE 0 END) AS n, count(DISTINCT CASE WHEN {_GR} THEN place_id END) AS p FROM cells GROUP BY ALL) SELECT year, taxon_group, CAST(sum(n) AS BIGINT) AS n, max(p) AS mesh FROM g GROUP BY ALL")
def taxon_group_years(spark, sf_dir):
    """Meshes are the most of any one source, not their union."""
    per = _summary("sum_group_year")(spark, sf_dir)
    return per.groupBy("year", "taxon_group").agg(F.sum("n").alias("n"), F.max("n_places").alias("mesh"))


@query(f"WITH {OCC} SELECT year, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN source_id LIKE '1-%' THEN n ELSE 0 END) AS BIGINT) AS n_first, CAST(sum(CASE WHEN source_id LIKE '2-%' THEN n ELSE 0 END) AS BIGINT) AS n_second FROM cells WHERE {_WS} GROUP BY ALL")
def effort_years(spark, sf_dir):
    part = lambda p: F.sum(F.when(F.col("source_id").startswith(p), F.col("n")).otherwise(0))
    return occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed'").groupBy("year").agg(F.sum("n").alias("n"), part("1-").alias("n_first"), part("2-").alias("n_second"))


@query(f"WITH {OCC}, s AS (SELECT year, binom, sum(n) AS n FROM cells WHERE {_WS} GROUP BY ALL), top AS (SELECT binom FROM s WHERE binom IS NOT NULL GROUP BY binom ORDER BY sum(n) DESC, binom LIMIT 5) SELECT year, CASE WHEN binom IN (SELECT binom FROM top) THEN binom ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY ALL")
def top_n_other(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed'").groupBy("year", "binom").agg(F.sum("n").alias("n"))
    top = rows.filter("binom IS NOT NULL").groupBy("binom").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "binom").limit(5).select(F.col("binom").alias("top"))  # five rows, so they can be broadcast
    joined = rows.join(F.broadcast(top), F.col("binom") == F.col("top"), "left")
    return joined.groupBy("year", F.coalesce("top", F.lit("other")).alias("label")).agg(F.sum("n").alias("n"))


@query(f"WITH {OCC} SELECT binom, CAST(sum(n) AS BIGINT) AS n, max(taxon_group) AS taxon_group FROM cells WHERE {_WS} AND region_id = 'region:1' AND lower(binom) LIKE '%brand#1%' GROUP BY binom HAVING sum(n_red_list) > 0 ORDER BY n DESC, binom LIMIT 10")
def species_search(spark, sf_dir):
    rows = occurrence_cells(spark, sf_dir).filter("place_kind = 'watershed' AND region_id = 'region:1'").filter(F.lower("binom").contains("brand#1"))
    found = rows.groupBy("binom").agg(F.sum("n").alias("n"), F.max("taxon_group").alias("taxon_group"), F.sum("n_red_list").alias("r")).filter("r > 0").drop("r")
    return found.orderBy(F.desc("n"), "binom").limit(10)


# Registries and red lists.


@query("WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand IS NULL, p_brand) AS rn, max(n) OVER (PARTITION BY p_type) AS m FROM n), t AS (SELECT p_type, count(*) AS n_ties FROM r WHERE n = m GROUP BY ALL) SELECT r.p_type, r.p_brand, r.n, n_ties FROM r JOIN t USING (p_type) WHERE rn = 1")
def mode_majority_vote(spark, sf_dir):
    return registry.majority(table(spark, sf_dir, "part"), ["p_type"], "p_brand")


_RANKED = "o AS (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders), d AS (SELECT a.o_custkey, a.rank AS now, b.rank AS before FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.rn = 2 WHERE a.rn = 1), e AS (SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN now < before THEN 'up' WHEN now > before THEN 'down' ELSE 'same' END AS direction FROM d)"


def _directions(spark, sf_dir):
    """The latest two assessments of each subject: a customer's last orders, whose priorities are severities."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    two = rows.withColumn("rn", last).filter("rn <= 2").groupBy("o_custkey").agg(F.max(F.when(F.col("rn") == 1, F.col("rank"))).alias("now"), F.max(F.when(F.col("rn") == 2, F.col("rank"))).alias("before"))
    return two.withColumn("direction", naming.direction(F.col("before"), F.col("now")))


@query(f"WITH {_RANKED} SELECT direction, now, count(*) AS n FROM e GROUP BY ALL")
def redlist_summary(spark, sf_dir):
    return _directions(spark, sf_dir).groupBy("direction", "now").agg(F.count("*").alias("n"))


@query(f"WITH {_RANKED} SELECT before, now, count(*) AS n FROM e WHERE before IS NOT NULL GROUP BY ALL")
def redlist_flows(spark, sf_dir):
    return _directions(spark, sf_dir).filter("before IS NOT NULL").groupBy("before", "now").agg(F.count("*").alias("n"))


@query(f"WITH {_RANKED} SELECT o_custkey, now, before, direction FROM e WHERE direction = 'up' ORDER BY now, o_custkey LIMIT 50")
def redlist_species(spark, sf_dir):
    return _directions(spark, sf_dir).filter("direction = 'up'").select("o_custkey", "now", "before", "direction").orderBy("now", "o_custkey").limit(50)


_LAND = "y AS (SELECT c_nationkey AS place, o_orderstatus AS class, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year, count(*) AS area FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), b AS (SELECT min(year) AS first, max(year) AS last FROM y)"


def _landuse(spark, sf_dir):
    """Areas by place, class and year: orders counted by nation and status."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("place"), F.col("o_orderstatus").alias("class"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("area"))


def _first_last(spark, sf_dir):
    rows = _landuse(spark, sf_dir)
    bounds = rows.agg(F.min("year").alias("first"), F.max("year").alias("last"))  # one row
    ends = rows.join(F.broadcast(bounds), F.col("year").isin(F.col("first"), F.col("last")))
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("year") == F.col(c), F.col("area"))), F.lit(0))
    return ends.groupBy("place", "class").agg(pick("first").alias("first_area"), pick("last").alias("last_area"))


_ENDS = f"{_LAND}, f AS (SELECT place, class, CAST(coalesce(sum(CASE WHEN year = first THEN area END), 0) AS BIGINT) AS first_area, CAST(coalesce(sum(CASE WHEN year = last THEN area END), 0) AS BIGINT) AS last_area FROM y, b WHERE year IN (first, last) GROUP BY ALL)"


@query(f"WITH {_ENDS} SELECT n_name AS name, class, first_area, last_area, last_area - first_area AS delta, CASE WHEN first_area > 0 THEN round((last_area - first_area) * 100.0 / first_area, 4) END AS pct FROM f JOIN nation ON place = n_nationkey")
def watershed_rollup(spark, sf_dir):
    delta = F.col("last_area") - F.col("first_area")
    rows = _first_last(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("place") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("name"), "class", "first_area", "last_area", delta.alias("delta"), F.when(F.col("first_area") > 0, F.round(delta * 100.0 / F.col("first_area"), 4)).alias("pct"))


@query(f"WITH {_ENDS} SELECT place, class, last_area - first_area AS delta FROM f ORDER BY delta DESC, place, class LIMIT 10")
def landuse_topk(spark, sf_dir):
    rows = _first_last(spark, sf_dir).select("place", "class", (F.col("last_area") - F.col("first_area")).alias("delta"))
    return rows.orderBy(F.desc("delta"), "place", "class").limit(10)


@query("SELECT (SELECT count(*) FROM supplier) AS sites, (SELECT count(*) FROM lineitem) AS observations, (SELECT count(DISTINCT p_type) FROM part) AS taxa, (SELECT count(*) FROM orders) AS records")
def overview_counts(spark, sf_dir):
    """Four scalars, each an aggregation of its own table; the single rows meet on a constant key."""
    one = lambda name, agg, alias: table(spark, sf_dir, name).agg(agg.alias(alias)).withColumn("k", F.lit(0))
    out = one("supplier", F.count("*"), "sites").join(one("lineitem", F.count("*"), "observations"), "k").join(one("part", F.countDistinct("p_type"), "taxa"), "k")
    return out.join(one("orders", F.count("*"), "records"), "k").drop("k")


@query("SELECT l_returnflag AS kind, n_name AS place, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS O, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS F, count(*) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def hazard_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    wide = rows.groupBy(F.col("l_returnflag").alias("kind"), F.col("n_name").alias("place")).pivot("l_linestatus", ["O", "F"]).count()
    wide = wide.select("kind", "place", F.coalesce("O", F.lit(0)).alias("O"), F.coalesce("F", F.lit(0)).alias("F"))
    return wide.withColumn("total", F.col("O") + F.col("F"))
