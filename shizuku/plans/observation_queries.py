"""Observation cube and series queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shizuku.functions import naming, periods
from shizuku.operators import checks, registry
from shizuku.operators import observation_cube as cube
from shizuku.plans.domain import DAYS, DIM, EVENTS, MONTHS, OBS, instants, monthly, observation, query, table
from shizuku.plans.stored_cells import levels

_CELL = f"{DIM}, period_start, period_end, grain, input_grain, stat, value_zero, value_lod, n, n_censored, n_not_detected"
_UNFOLD = "CROSS JOIN (SELECT unnest(['mean', 'min', 'max']) AS stat)"
_PICK = "CASE stat WHEN 'mean' THEN vz_mean WHEN 'min' THEN vz_min ELSE vz_max END AS value_zero, CASE stat WHEN 'mean' THEN vl_mean WHEN 'min' THEN vl_min ELSE vl_max END AS value_lod"
_WIDE = "avg(v_zero) AS vz_mean, min(v_zero) AS vz_min, max(v_zero) AS vz_max, avg(v_lod) AS vl_mean, min(v_lod) AS vl_min, max(v_lod) AS vl_max, count(*) AS n, count(*) FILTER (WHERE censoring = 'below_lod') AS n_censored, count(*) FILTER (WHERE censoring = 'not_detected') AS n_not_detected"
_MONTH = f"""mon AS (SELECT {DIM}, input_grain, substr(period_start, 1, 7) AS m, round(avg(vz_mean), 9) AS value_zero, round(avg(vl_mean), 9) AS value_lod, count(*) AS n,
  CAST(sum(n_censored) AS BIGINT) AS n_censored, CAST(sum(n_not_detected) AS BIGINT) AS n_not_detected FROM days GROUP BY ALL)"""


def rounded(df, digits: int = 6):
    return df.withColumn("value_zero", F.round("value_zero", digits)).withColumn("value_lod", F.round("value_lod", digits))


def days_of(spark, sf_dir):
    """The daily cells, as stored or from the facts."""
    return levels(spark, sf_dir)[0].cells().drop("zone_id").withColumn("period_end", F.col("period_start")).withColumn("grain", F.lit("day"))


def _mean(p: str, digits: int = 6):
    """The mean of the daily means that a stored level has added up."""
    return F.round(F.col(f"{p}_mean_s").cast("double") / F.col(f"{p}_mean_c"), digits)


def exact_mean(column: str, digits: int = 9):
    """The mean of values of up to so many decimals, added up exactly: it doesn't depend on the order of rows."""
    return F.sum(F.round(column, digits).cast(f"decimal(28,{digits})")).cast("double") / F.count(column)


@query(f"WITH {DAYS} SELECT {DIM}, period_start, period_start AS period_end, 'day' AS grain, input_grain, stat, round(value_zero, 6) AS value_zero, round(value_lod, 6) AS value_lod, n, n_censored, n_not_detected FROM (SELECT *, {_PICK} FROM days {_UNFOLD})")
def obs_daily(spark, sf_dir):
    return rounded(cube.unfold(days_of(spark, sf_dir), ["mean", "min", "max"]))


@query(f"WITH {DAYS} SELECT {DIM}, period_start, period_start AS period_end, 'day' AS grain, input_grain, 'sum' AS stat, round(vz_sum, 6) AS value_zero, round(vl_sum, 6) AS value_lod, n, n_censored, n_not_detected FROM days WHERE variable_id IN ('R', 'N') AND (obs_stat IS NULL OR obs_stat = 'sum')")
def obs_daily_sum(spark, sf_dir):
    variables = spark.createDataFrame([("A", "mean"), ("N", "sum"), ("R", "sum")], "variable_id string, default_stat string")
    return rounded(cube.day_sums(days_of(spark, sf_dir), variables))


@query(f"WITH {DAYS}, mon AS (SELECT {DIM}, input_grain, substr(period_start, 1, 7) AS m, avg(vz_mean) AS z, avg(vl_mean) AS l, count(*) AS n, CAST(sum(n_censored) AS BIGINT) AS n_censored, CAST(sum(n_not_detected) AS BIGINT) AS n_not_detected FROM days GROUP BY ALL) SELECT {DIM}, m || '-01' AS period_start, strftime(last_day(CAST(m || '-01' AS DATE)), '%Y-%m-%d') AS period_end, 'month' AS grain, input_grain, 'mean' AS stat, round(z, 6) AS value_zero, round(l, 6) AS value_lod, n, n_censored, n_not_detected FROM mon")
def obs_month_from_day(spark, sf_dir):
    rows = levels(spark, sf_dir)[0].level("month")
    cells = rows.withColumns({"period_start": F.concat("month", F.lit("-01")), "period_end": periods.month_end(F.col("month")), "grain": F.lit("month"), "stat": F.lit("mean"), "value_zero": _mean("vz"), "value_lod": _mean("vl"), "n": F.col("cells")})
    return cells.select(*cube.CELL)


_YEAR = f"yr AS (SELECT {DIM}, input_grain, substr(period_start, 1, 4) AS y, avg(vz_mean) AS vz_mean, min(vz_mean) AS vz_min, max(vz_mean) AS vz_max, avg(vl_mean) AS vl_mean, min(vl_mean) AS vl_min, max(vl_mean) AS vl_max, count(*) AS n, CAST(sum(n_censored) AS BIGINT) AS n_censored, CAST(sum(n_not_detected) AS BIGINT) AS n_not_detected FROM days GROUP BY ALL)"
_YEARS = f"{DAYS}, {_YEAR}, years AS (SELECT {DIM}, y || '-01-01' AS period_start, y || '-12-31' AS period_end, 'year' AS grain, input_grain, stat, round(value_zero, 6) AS value_zero, round(value_lod, 6) AS value_lod, n, n_censored, n_not_detected FROM (SELECT *, {_PICK} FROM yr {_UNFOLD}))"


def years_of(spark, sf_dir, chosen=None):
    """Yearly cells, from the level of years. chosen: takes some of its rows, or of the facts', by the keys that both have."""
    days = levels(spark, sf_dir, chosen=chosen)[0]
    rows = days.level("year")
    rows = chosen(rows) if chosen and days.made is None else rows
    start, end = periods.year_bounds(F.col("year"))
    wide = {f"{p}_{k}": c for p in ("vz", "vl") for k, c in (("mean", _mean(p)), ("min", F.round(f"{p}_mean_lo", 6)), ("max", F.round(f"{p}_mean_hi", 6)))}
    return cube.unfold(rows.withColumns({"period_start": start, "period_end": end, "grain": F.lit("year"), "n": F.col("cells"), **wide}), ["mean", "min", "max"])


@query(f"WITH {_YEARS} SELECT * FROM years")
def obs_year_from_day(spark, sf_dir):
    return years_of(spark, sf_dir)


@query(f"""WITH {MONTHS}, w AS (SELECT {DIM}, CAST(substr(period_start, 1, 4) AS INTEGER) - CASE WHEN CAST(substr(period_start, 6, 2) AS INTEGER) < 4 THEN 1 ELSE 0 END AS y, {_WIDE}
  FROM mem WHERE period_grain = 'month' AND value_grain <> 'month' GROUP BY ALL)
SELECT {DIM}, y || '-04-01' AS period_start, (y + 1) || '-03-31' AS period_end, 'fiscal_year' AS grain, 'month' AS input_grain, stat, round(value_zero, 6) AS value_zero, round(value_lod, 6) AS value_lod, n, n_censored, n_not_detected FROM (SELECT *, {_PICK} FROM w {_UNFOLD})""")
def obs_fiscal_rollup(spark, sf_dir):
    return rounded(cube.declared_rollup(cube.imputed(monthly(spark, sf_dir)), "fiscal_year"))


@query(f"WITH {MONTHS}, w AS (SELECT {DIM}, period_start, period_end, period_grain AS grain, period_grain AS input_grain, {_WIDE} FROM mem GROUP BY ALL) SELECT {DIM}, period_start, period_end, grain, input_grain, stat, round(value_zero, 6) AS value_zero, round(value_lod, 6) AS value_lod, n, n_censored, n_not_detected FROM (SELECT *, {_PICK} FROM w {_UNFOLD})")
def obs_source_cells(spark, sf_dir):
    return rounded(cube.source_cells(cube.imputed(monthly(spark, sf_dir)), ["month", "year"]))


@query(f"WITH {EVENTS}, w AS (SELECT {DIM}, period_grain AS input_grain, substr(period_start, 1, 10) AS period_start, {_WIDE} FROM mem WHERE v_zero IS NOT NULL GROUP BY ALL) SELECT {DIM}, period_start, period_start AS period_end, 'day' AS grain, input_grain, stat, round(value_zero, 6) AS value_zero, round(value_lod, 6) AS value_lod, n, n_censored, n_not_detected FROM (SELECT *, {_PICK} FROM w {_UNFOLD})")
def obs_instants_to_day(spark, sf_dir):
    return rounded(cube.unfold(cube.day_stats(cube.imputed(instants(spark, sf_dir))), ["mean", "min", "max"]))


@query(f"WITH {DAYS}, c AS (SELECT *, {_PICK} FROM days {_UNFOLD}) SELECT count(*) FILTER (WHERE (value_zero IS NULL) <> (value_lod IS NULL)) AS one_series_only, count(*) FILTER (WHERE value_zero > value_lod + 1e-9) AS zero_above_limit, count(*) FILTER (WHERE n_censored = 0 AND abs(value_zero - value_lod) > 1e-9) AS differ_uncensored, count(*) FILTER (WHERE n_censored + n_not_detected > n) AS more_than_n, count(*) FILTER (WHERE n_not_detected = n AND value_zero IS NOT NULL) AS value_without_detection FROM c")
def cell_invariants(spark, sf_dir):
    return checks.cell_violations(cube.unfold(days_of(spark, sf_dir), ["mean", "min", "max"]))


@query("WITH h AS (SELECT user_id, event_type, ts AS label, ts - INTERVAL 1 HOUR AS began FROM events) SELECT user_id, event_type, strftime(began, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE strftime(began, '%Y-%m-%d') <> strftime(label, '%Y-%m-%d')) AS n_shifted FROM h GROUP BY ALL")
def hourly_daily_identity(spark, sf_dir):
    """Labels that end an hour, by the day on which the hour began: midnight belongs to the day before."""
    label = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    began, _ = periods.hour_ending(label)
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.substring(began, 1, 10).alias("day"), F.substring(label, 1, 10).alias("label_day"))
    return rows.groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"), F.count_if(F.col("day") != F.col("label_day")).alias("n_shifted"))


@query(f"WITH {DAYS}, k AS (SELECT {DIM}, input_grain, period_start, count(*) AS c FROM days GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS repeated FROM k")
def cube_unique_keys(spark, sf_dir):
    return checks.repeated_keys(days_of(spark, sf_dir), [*cube.DIMS, "input_grain", "period_start"]).agg(F.count("*").alias("repeated"))


@query(f"WITH {OBS}, a AS (SELECT variable_id, obs_stat, count(*) AS left_value FROM mem GROUP BY ALL), b AS (SELECT variable_id, obs_stat, count(*) AS right_value FROM mem WHERE v_zero IS NOT NULL GROUP BY ALL) SELECT a.variable_id, a.obs_stat, left_value, right_value FROM a LEFT JOIN b ON a.variable_id = b.variable_id AND a.obs_stat IS NOT DISTINCT FROM b.obs_stat WHERE left_value IS DISTINCT FROM right_value")
def totals_reconcile(spark, sf_dir):
    """Rows by series against those with a value: a full outer join on null-safe keys that keeps what differs."""
    from shizuku.functions import censoring

    obs = observation(spark, sf_dir).withColumn("one", F.lit(1).cast("long"))
    valued = obs.filter(censoring.zero_series(F.col("censoring"), F.col("value_num")).isNotNull())
    return checks.unequal_totals(obs, valued, ["variable_id", "obs_stat"], "one")


# Series and scopes.


@query(f"WITH {_YEARS} SELECT place_id, variable_id, obs_stat, unit_id, substr(period_start, 1, 4) AS year, max(CASE WHEN stat = 'mean' THEN value_zero END) AS mean, max(CASE WHEN stat = 'min' THEN value_zero END) AS min, max(CASE WHEN stat = 'max' THEN value_zero END) AS max, max(n) AS n FROM years WHERE variable_id = 'R' GROUP BY place_id, variable_id, obs_stat, unit_id, substr(period_start, 1, 4)")
def year_series_pivot(spark, sf_dir):
    """One wide row a series and year: the stored level has the statistics side by side."""
    rows = levels(spark, sf_dir)[0].level("year").filter("variable_id = 'R'")
    return rows.groupBy("place_id", "variable_id", "obs_stat", "unit_id", "year").agg(F.max(_mean("vz")).alias("mean"), F.max(F.round("vz_mean_lo", 6)).alias("min"), F.max(F.round("vz_mean_hi", 6)).alias("max"), F.max("cells").alias("n"))


@query(f"WITH {DAYS} SELECT place_id, substr(period_start, 1, 7) AS month, round(avg(vz_mean), 6) AS value, count(*) AS n FROM days WHERE variable_id = 'A' AND unit_id = 'F' AND obs_stat = 'mean' AND place_id IN ('site:1', 'site:2', 'site:3') GROUP BY ALL")
def month_series(spark, sf_dir):
    where = "variable_id = 'A' AND unit_id = 'F' AND obs_stat = 'mean' AND place_id IN ('site:1', 'site:2', 'site:3')"
    found = levels(spark, sf_dir)[0].answer(["place_id", "month"], {"value": ("mean", "vz_mean"), "n": ("count",)}, where, ["variable_id", "unit_id", "obs_stat"])
    return found.withColumn("value", F.round("value", 6))


@query(f"WITH {DAYS} SELECT place_id, period_start, round(vz_mean, 6) AS value FROM days WHERE variable_id || '|' || value_grain || '|' || coalesce(obs_stat, '') || '|' || unit_id = 'N|day||O' AND period_start >= '1996-01' AND period_start <= '1996-06'")
def day_series(spark, sf_dir):
    """One series by its key; the bounds of a period are texts, so an upper bound of a month ends before its first day."""
    key = naming.series_key(F.col("variable_id"), F.col("value_grain"), F.col("obs_stat"), F.col("unit_id"))
    rows = days_of(spark, sf_dir).filter((key == "N|day||O") & F.col("period_start").between("1996-01", "1996-06"))
    return rows.select("place_id", "period_start", F.round("vz_mean", 6).alias("value"))


@query(f"WITH {_YEARS} SELECT n_nationkey AS zone, substr(period_start, 1, 4) AS year, variable_id, count(DISTINCT place_id) AS n_sites, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(CAST(round(value_zero, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(value_zero), 4) AS avg_zero, round(CAST(sum(CAST(round(value_lod, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(value_lod), 4) AS avg_lod FROM years JOIN supplier ON place_id = 'site:' || s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE stat = 'mean' GROUP BY ALL")
def zone_year(spark, sf_dir):
    """Means of yearly means by zone: the stored level of exactly these keys."""
    measures = {"n_sites": ("distinct", "place_id"), "n": ("total", "n"), "avg_zero": ("mean", "value_zero"), "avg_lod": ("mean", "value_lod")}
    found = levels(spark, sf_dir, zones=True)[1].answer(["zone_id", "year", "variable_id"], measures, "zone_id IS NOT NULL")
    return found.select(F.col("zone_id").alias("zone"), "year", "variable_id", "n_sites", "n", F.round("avg_zero", 4).alias("avg_zero"), F.round("avg_lod", 4).alias("avg_lod"))


@query(f"WITH {DAYS} SELECT n_nationkey AS zone, substr(period_start, 6, 2) AS month_of_year, variable_id, count(*) AS n, round(CAST(sum(CAST(round(vz_mean, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(vz_mean), 4) AS avg, min(vz_mean) AS min, max(vz_mean) AS max FROM days JOIN supplier ON place_id = 'site:' || s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def zone_month(spark, sf_dir):
    found = levels(spark, sf_dir, zones=True)[0].answer(["zone_id", "month_of_year", "variable_id"], {"n": ("count",), "avg": ("mean", "vz_mean"), "min": ("min", "vz_mean"), "max": ("max", "vz_mean")}, "zone_id IS NOT NULL")
    return found.select(F.col("zone_id").alias("zone"), "month_of_year", "variable_id", "n", F.round("avg", 4).alias("avg"), "min", "max")


@query(f"WITH {DAYS} SELECT variable_id, substr(period_start, 6, 2) AS month_of_year, count(*) AS n, round(CAST(sum(CAST(round(vz_mean, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(vz_mean), 4) AS avg_zero, round(CAST(sum(CAST(round(vl_mean, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(vl_mean), 4) AS avg_lod, min(vz_mean) AS min, max(vz_mean) AS max, round(sum(vz_sum) / count(DISTINCT substr(period_start, 1, 4)), 4) AS sum_per_year FROM days GROUP BY ALL")
def climatology(spark, sf_dir):
    measures = {"n": ("count",), "avg_zero": ("mean", "vz_mean"), "avg_lod": ("mean", "vl_mean"), "min": ("min", "vz_mean"), "max": ("max", "vz_mean"), "total": ("sum", "vz_sum"), "years": ("distinct", "year")}
    found = levels(spark, sf_dir)[0].answer(["variable_id", "month_of_year"], measures)
    return found.select("variable_id", "month_of_year", "n", F.round("avg_zero", 4).alias("avg_zero"), F.round("avg_lod", 4).alias("avg_lod"), "min", "max", F.round(F.col("total") / F.col("years"), 4).alias("sum_per_year"))


@query(f"WITH {DAYS} SELECT place_id, variable_id, count(*) AS n_days, min(period_start) AS first_day, max(period_start) AS last_day, round(CAST(sum(CAST(round(vz_mean, 9) AS DECIMAL(28,9))) AS DOUBLE) / count(vz_mean), 4) AS avg FROM days GROUP BY ALL")
def place_summary(spark, sf_dir):
    found = levels(spark, sf_dir)[0].answer(["place_id", "variable_id"], {"n_days": ("count",), "first_day": ("first",), "last_day": ("last",), "avg": ("mean", "vz_mean")})
    return found.withColumn("avg", F.round("avg", 4))


@query(f"WITH {DAYS} SELECT variable_id, obs_stat, unit_id, value_grain, CAST(sum(CASE WHEN input_grain = 'day' THEN n ELSE 0 END) AS BIGINT) AS n_daily, CAST(sum(CASE WHEN input_grain <> 'day' THEN n ELSE 0 END) AS BIGINT) AS n_annual, count(DISTINCT place_id) AS n_places FROM days GROUP BY ALL")
def series_summary(spark, sf_dir):
    """Values and places by series: totals of each place first, so that one pass gives both."""
    keys, daily = ["variable_id", "obs_stat", "unit_id", "value_grain"], F.col("input_grain") == "day"
    counts = levels(spark, sf_dir)[0].answer([*keys, "input_grain", "place_id"], {"n": ("total", "n")})
    return counts.groupBy(*keys).agg(F.sum(F.when(daily, F.col("n")).otherwise(0)).alias("n_daily"), F.sum(F.when(~daily, F.col("n")).otherwise(0)).alias("n_annual"), F.countDistinct("place_id").alias("n_places"))


@query(f"""WITH {DAYS}, s AS (SELECT variable_id, obs_stat, unit_id, CAST(sum(n) AS BIGINT) AS n FROM days GROUP BY ALL), p AS (SELECT variable_id, count(DISTINCT place_id) AS n_places FROM days GROUP BY ALL),
u AS (SELECT variable_id, unit_id, row_number() OVER (PARTITION BY variable_id ORDER BY t DESC, unit_id) AS rn FROM (SELECT variable_id, unit_id, sum(n) AS t FROM s WHERE unit_id IS NOT NULL GROUP BY ALL))
SELECT s.variable_id, CAST(sum(s.n) AS BIGINT) AS n, count(*) AS n_series, any_value(n_places) AS n_places, any_value(u.unit_id) AS unit_id, string_agg(DISTINCT s.obs_stat, ',' ORDER BY s.obs_stat) AS stats FROM s JOIN p USING (variable_id) LEFT JOIN u ON u.variable_id = s.variable_id AND rn = 1 GROUP BY s.variable_id""")
def variable_catalog(spark, sf_dir):
    """Series bundled to variables: places are counted anew, never added up; the unit with the most values stands for all."""
    days = levels(spark, sf_dir)[0]
    series = days.answer(["variable_id", "obs_stat", "unit_id"], {"n": ("total", "n")})
    places = days.answer(["variable_id"], {"n_places": ("distinct", "place_id")})
    units = series.filter("unit_id IS NOT NULL").groupBy("variable_id", "unit_id").agg(F.sum("n").alias("n"))
    unit = registry.latest(units, ["variable_id"], [F.col("n").desc(), F.col("unit_id")]).select("variable_id", "unit_id")
    whole = series.groupBy("variable_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_series"), F.array_join(F.array_sort(F.collect_set("obs_stat")), ",").alias("stats"))
    return whole.join(places, "variable_id").join(unit, "variable_id", "left")


@query(f"WITH {DAYS} SELECT region_id, variable_id, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT place_id) AS n_places, min(period_start) AS first_day, max(period_start) AS last_day FROM days GROUP BY ALL")
def variable_catalog_by_region(spark, sf_dir):
    return levels(spark, sf_dir)[0].answer(["region_id", "variable_id"], {"n": ("total", "n"), "n_places": ("distinct", "place_id"), "first_day": ("first",), "last_day": ("last",)})


@query(f"WITH {DAYS} SELECT value_grain AS dataset, coalesce(obs_stat, 'any') AS stat, variable_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_censored) AS BIGINT) AS n_censored, count(DISTINCT place_id) AS n_places, count(DISTINCT substr(period_start, 1, 4)) AS n_years FROM days GROUP BY ALL")
def variable_catalog_by_dataset(spark, sf_dir):
    days = levels(spark, sf_dir)[0]
    keys = ["value_grain", "obs_stat", "variable_id"]
    found = days.answer(keys, {"n": ("total", "n"), "n_censored": ("total", "n_censored"), "n_places": ("distinct", "place_id"), "n_years": ("distinct", "year")})
    return found.select(F.col("value_grain").alias("dataset"), F.coalesce("obs_stat", F.lit("any")).alias("stat"), "variable_id", "n", "n_censored", "n_places", "n_years")


@query(f"WITH {DAYS} SELECT place_id, variable_id, obs_stat, unit_id, input_grain, CAST(sum(n) AS BIGINT) AS n, min(substr(period_start, 1, 4)) AS y_from, max(substr(period_start, 1, 4)) AS y_to FROM days WHERE place_id = 'site:7' GROUP BY ALL")
def site_variables(spark, sf_dir):
    found = levels(spark, sf_dir)[0].answer(["place_id", "variable_id", "obs_stat", "unit_id", "input_grain"], {"n": ("total", "n"), "first": ("first",), "last": ("last",)}, "place_id = 'site:7'")
    return found.select("place_id", "variable_id", "obs_stat", "unit_id", "input_grain", "n", F.substring("first", 1, 4).alias("y_from"), F.substring("last", 1, 4).alias("y_to"))


@query(f"WITH {DAYS}, r AS (SELECT place_id, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT variable_id || '|' || coalesce(obs_stat, '') || '|' || unit_id) AS n_series, count(DISTINCT variable_id) AS n_variables FROM days GROUP BY ALL) SELECT s_suppkey AS site, s_name AS name, s_nationkey AS zone, coalesce(n, 0) AS n, coalesce(n_series, 0) AS n_series, coalesce(n_variables, 0) AS n_variables FROM supplier LEFT JOIN r ON place_id = 'site:' || s_suppkey")
def sites_list(spark, sf_dir):
    key = naming.series_key(F.col("variable_id"), F.lit(None).cast("string"), F.col("obs_stat"), F.col("unit_id"))
    series = levels(spark, sf_dir)[0].answer(["place_id", "variable_id", "obs_stat", "unit_id"], {"n": ("total", "n")})
    rolled = series.groupBy("place_id").agg(F.sum("n").alias("n"), F.countDistinct(key).alias("n_series"), F.countDistinct("variable_id").alias("n_variables"))
    sites = table(spark, sf_dir, "supplier").withColumn("place_id", F.concat(F.lit("site:"), "s_suppkey"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sites.join(rolled, "place_id", "left").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("zone"), zero("n"), zero("n_series"), zero("n_variables"))


@query(f"WITH {DAYS}, p AS (SELECT s_nationkey AS water, place_id, sum(n) AS n FROM days JOIN supplier ON place_id = 'site:' || s_suppkey GROUP BY ALL) SELECT water, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY water HAVING count(*) >= 2")
def water_bodies(spark, sf_dir):
    per_site = levels(spark, sf_dir, zones=True)[0].answer(["zone_id", "place_id"], {"n": ("total", "n")}, "zone_id IS NOT NULL")
    return per_site.groupBy(F.col("zone_id").alias("water")).agg(F.count("*").alias("n_sites"), F.sum("n").alias("n")).filter("n_sites >= 2")


@query("WITH e AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(strftime(ts, '%H') AS INTEGER) AS h, value FROM events), s AS (SELECT user_id, event_type, day, h, max(floor(value * 1000)) AS v FROM e GROUP BY ALL) SELECT user_id, event_type, day, round(avg(v), 3) AS mean, min(v) AS min, max(v) AS max, count(v) AS n_obs, 24 - count(v) AS n_missing FROM s GROUP BY ALL")
def wide_to_daily(spark, sf_dir):
    """24 hourly columns per row, folded to daily mean, extremes and counts of values that are there."""
    hours = [f"{h:02d}" for h in range(24)]
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("h"), F.floor(F.col("value") * 1000).cast("double").alias("v"))
    wide = rows.groupBy("user_id", "event_type", "day").pivot("h", hours).agg(F.max("v"))
    valid = F.filter(F.array(*(F.col(f"`{h}`") for h in hours)), lambda x: x.isNotNull())
    total = F.aggregate("valid", F.lit(0.0), lambda s, x: s + x)
    return wide.withColumn("valid", valid).select("user_id", "event_type", "day", F.round(total / F.size("valid"), 3).alias("mean"), F.array_min("valid").alias("min"), F.array_max("valid").alias("max"), F.size("valid").cast("long").alias("n_obs"), (24 - F.size("valid")).cast("long").alias("n_missing"))


@query(f"WITH {DAYS}, peak AS (SELECT place_id, substr(period_start, 1, 4) AS year, arg_max(period_start, (vz_sum, period_start)) AS day, max(vz_sum) AS total FROM days WHERE vz_sum IS NOT NULL GROUP BY ALL) SELECT place_id, year, day, total FROM peak")
def peak_days(spark, sf_dir):
    """The day with the greatest sum in each year, the later of equal ones."""
    best = days_of(spark, sf_dir).filter("vz_sum IS NOT NULL").groupBy("place_id", F.substring("period_start", 1, 4).alias("year")).agg(F.max(F.struct("vz_sum", "period_start")).alias("b"))
    return best.select("place_id", "year", F.col("b.period_start").alias("day"), F.col("b.vz_sum").alias("total"))


@query(f"""WITH {OBS}, v AS (SELECT variable_id, obs_stat, unit_id FROM (SELECT DISTINCT variable_id, obs_stat, unit_id FROM obs)) SELECT variable_id, count(*) AS n_values FROM v GROUP BY variable_id HAVING count(*) > 1""")
def alias_functional(spark, sf_dir):
    from shizuku.operators.checks import not_functional

    return not_functional(observation(spark, sf_dir).withColumn("obs_stat", F.coalesce("obs_stat", F.lit("-"))), ["variable_id"], ["obs_stat", "unit_id"])


@query("WITH a(dataset, alias, source_id, variable_id) AS (VALUES ('A', 'F', NULL, 'v1'), ('N', 'O', 0, 'v2'), ('R', 'F', 1, 'v3'), ('N', 'O', NULL, 'v4')), m AS (SELECT l_returnflag AS dataset, l_linestatus AS alias, CASE WHEN l_linenumber % 3 < 2 THEN l_linenumber % 3 END AS source_id FROM lineitem) SELECT m.dataset, m.alias, m.source_id, a.variable_id, count(*) AS n FROM m LEFT JOIN a ON m.dataset = a.dataset AND m.alias = a.alias AND m.source_id IS NOT DISTINCT FROM a.source_id GROUP BY ALL")
def alias_nullsafe_join(spark, sf_dir):
    aliases = spark.createDataFrame([("A", "F", None, "v1"), ("N", "O", 0, "v2"), ("R", "F", 1, "v3"), ("N", "O", None, "v4")], "dataset string, alias string, source_id int, variable_id string")
    part = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("alias"), F.when(part < 2, part).alias("source_id"))
    # Rows of one key are alike, so they are counted before the join.
    keys = rows.groupBy("dataset", "alias", "source_id").count()
    return registry.with_alias(keys, aliases).groupBy("dataset", "alias", "source_id", "variable_id").agg(F.sum("count").alias("n"))


@query("SELECT s_nationkey AS zone, count(*) AS n, round(stddev_pop(s_acctbal), 4) AS sd, round(avg(s_acctbal), 4) AS mean, round(regr_slope(s_acctbal, s_suppkey), 6) AS slope, round(regr_intercept(s_acctbal, s_suppkey), 4) AS intercept FROM supplier GROUP BY ALL HAVING count(*) > 2")
def regr_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone"))
    return rows.agg(F.count("*").alias("n"), F.round(F.stddev_pop("s_acctbal"), 4).alias("sd"), F.round(F.avg("s_acctbal"), 4).alias("mean"), F.round(F.regr_slope("s_acctbal", "s_suppkey"), 6).alias("slope"), F.round(F.regr_intercept("s_acctbal", "s_suppkey"), 4).alias("intercept")).filter("n > 2")
