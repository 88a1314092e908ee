"""The observation cube: cells by place, variable and series at day, month, year and fiscal-year grain.

Every family of cells is one aggregation that computes all statistics of both imputations at once; the statistics are then
unfolded into rows. Months and years read the daily means of the same pass, so that the facts are shuffled once by day and their
far fewer daily cells once more by month and by year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shizuku.functions import censoring, periods

DIMS = ["region_id", "place_id", "place_kind", "variable_id", "obs_stat", "unit_id", "value_grain"]
CELL = [*DIMS, "period_start", "period_end", "grain", "input_grain", "stat", "value_zero", "value_lod", "n", "n_censored", "n_not_detected"]


def imputed(observation: DataFrame) -> DataFrame:
    """Members of cells, with v_zero and v_lod."""
    c, v = F.col("censoring"), F.col("value_num")
    rows = observation.withColumn("v_zero", censoring.zero_series(c, v)).withColumn("v_lod", censoring.limit_series(c, v, F.col("censoring_limit")))
    return rows.filter(censoring.is_member(F.col("v_zero"), c))


def _stats(zero: str = "v_zero", lod: str = "v_lod") -> list[Column]:
    return [f(c).alias(f"{p}_{n}") for p, c in (("vz", zero), ("vl", lod)) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("sum", F.sum))]


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.col("censoring") == "below_lod").alias("n_censored"), F.count_if(F.col("censoring") == "not_detected").alias("n_not_detected")]


def unfold(wide: DataFrame, stats: list[str]) -> DataFrame:
    """One row for each statistic of a wide row."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(f"vz_{s}").alias("value_zero"), F.col(f"vl_{s}").alias("value_lod")) for s in stats)))
    return wide.withColumn("s", each).select(*(F.col(f"s.{c}") if c in ("stat", "value_zero", "value_lod") else F.col(c) for c in CELL))


_OF_DAYS = ("day", "hour", "instant")


def in_days(members: DataFrame) -> DataFrame:
    """The members of daily cells with their cells' keys and what each adds to the counts."""
    each = {"n": F.lit(True), "n_censored": F.col("censoring") == "below_lod", "n_not_detected": F.col("censoring") == "not_detected"}
    rows = members.filter(F.col("period_grain").isin(*_OF_DAYS))
    return rows.select(*DIMS, F.col("period_grain").alias("input_grain"), F.substring("period_start", 1, 10).alias("period_start"), *(F.when(c, 1).otherwise(0).cast("long").alias(k) for k, c in each.items()))


def day_stats(members: DataFrame, keys: list[str] = DIMS, day: Column | None = None) -> DataFrame:
    """Daily cells of observations of a day, an hour or an instant, all statistics in one row.

    keys and day: other columns that tell the same cells apart as DIMS and the text of the day do, numbers say; the cells then have these.
    """
    day = F.substring("period_start", 1, 10) if day is None else day
    rows = members.filter(F.col("period_grain").isin(*_OF_DAYS))
    wide = rows.groupBy(*keys, F.col("period_grain").alias("input_grain"), day.alias("period_start")).agg(*_stats(), *_counts())
    return wide.withColumn("period_end", F.col("period_start")).withColumn("grain", F.lit("day"))


def day_sums(days: DataFrame, variables: DataFrame) -> DataFrame:
    """Sums, for variables that add up and series that don't name another statistic."""
    adds = variables.filter(F.col("default_stat") == "sum").select("variable_id")
    return unfold(days.filter("obs_stat IS NULL OR obs_stat = 'sum'").join(adds, "variable_id", "left_semi"), ["sum"])


def month_from_days(days: DataFrame) -> DataFrame:
    """Monthly means of daily means; n is the number of days."""
    month = F.substring("period_start", 1, 7)
    wide = days.groupBy(*DIMS, "input_grain", month.alias("m")).agg(F.avg("vz_mean").alias("vz_mean"), F.avg("vl_mean").alias("vl_mean"), F.count("*").alias("n"), F.sum("n_censored").alias("n_censored"), F.sum("n_not_detected").alias("n_not_detected"))
    wide = wide.withColumn("period_start", F.concat("m", F.lit("-01"))).withColumn("period_end", periods.month_end(F.col("m"))).withColumn("grain", F.lit("month"))
    return unfold(wide, ["mean"])


def year_from_days(days: DataFrame) -> DataFrame:
    """Mean, least and greatest daily mean of a year; n is the number of days."""
    year = F.substring("period_start", 1, 4)
    stats = [f(f"{p}_mean").alias(f"{p}_{n}") for p in ("vz", "vl") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    wide = days.groupBy(*DIMS, "input_grain", year.alias("y")).agg(*stats, F.count("*").alias("n"), F.sum("n_censored").alias("n_censored"), F.sum("n_not_detected").alias("n_not_detected"))
    start, end = periods.year_bounds(F.col("y"))
    return unfold(wide.withColumn("period_start", start).withColumn("period_end", end).withColumn("grain", F.lit("year")), ["mean", "min", "max"])


def source_cells(members: DataFrame, grains: list[str]) -> DataFrame:
    """Cells at the grain that the source gives itself."""
    rows = members.filter(F.col("period_grain").isin(*grains))
    wide = rows.groupBy(*DIMS, "period_start", "period_end", "period_grain").agg(*_stats(), *_counts())
    return unfold(wide.withColumn("grain", F.col("period_grain")).withColumn("input_grain", F.col("period_grain")), ["mean", "min", "max"])


def declared_rollup(members: DataFrame, grain: str) -> DataFrame:
    """Years or fiscal years of daily values whose dates tell the month only, where a source declares that roll-up."""
    rows = members.filter((F.col("period_grain") == "month") & (F.col("value_grain") != "month"))
    year = periods.fiscal_year_of(F.col("period_start")) if grain == "fiscal_year" else F.substring("period_start", 1, 4).cast("int")
    wide = rows.groupBy(*DIMS, year.alias("y")).agg(*_stats(), *_counts())
    start, end = periods.fiscal_bounds(F.col("y")) if grain == "fiscal_year" else periods.year_bounds(F.col("y"))
    wide = wide.withColumn("period_start", start).withColumn("period_end", end).withColumn("grain", F.lit(grain)).withColumn("input_grain", F.lit("month"))
    return unfold(wide, ["mean", "min", "max"])


def cube(observation: DataFrame, variables: DataFrame, rollups: tuple[str, ...] = ("fiscal_year",)) -> DataFrame:
    """All families of cells."""
    members = imputed(observation)
    days = day_stats(members)
    parts = [unfold(days, ["mean", "min", "max"]), day_sums(days, variables), month_from_days(days), year_from_days(days), source_cells(members, ["month"]), source_cells(members, ["year", "fiscal_year"])]
    return reduce(DataFrame.unionByName, parts + [declared_rollup(members, g) for g in rollups])
