"""Checks as tables of violations: empty means that the check holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, nulls equal, with more than one row."""
    return df.groupBy(*keys).count().filter("count > 1")


def unequal_totals(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left_value, right_value where the sums of two tables differ or one side is missing."""
    a = left.groupBy(*keys).agg(F.sum(value).alias("left_value"))
    b = right.groupBy(*(F.col(k).alias(f"r_{k}") for k in keys)).agg(F.sum(value).alias("right_value"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"r_{k}"))
    joined = a.withColumn("has_left", F.lit(1)).join(b.withColumn("has_right", F.lit(1)), on, "full_outer")
    out = joined.filter("has_left IS NULL OR has_right IS NULL OR NOT (left_value <=> right_value)")
    pick = lambda k: F.when(F.col("has_left").isNotNull(), F.col(k)).otherwise(F.col(f"r_{k}")).alias(k)
    return out.select(*map(pick, keys), "left_value", "right_value")


def not_functional(df: DataFrame, keys: list[str], value: list[str]) -> DataFrame:
    """Keys that have more than one value."""
    return df.groupBy(*keys).agg(F.countDistinct(F.struct(*value)).alias("n_values")).filter("n_values > 1")


def set_difference(actual: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: 'missing' for declared rows that aren't there, 'stale' for those that nobody declared."""
    a, d = actual.select(*keys).distinct(), declared.select(*keys).distinct()
    return d.exceptAll(a).withColumn("side", F.lit("missing")).unionByName(a.exceptAll(d).withColumn("side", F.lit("stale")))


def unresolved(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).join(other.select(key), key, "left_anti")


def cell_violations(cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Counts of cells that break the invariants of the two series, in one pass."""
    z, v = F.col("value_zero"), F.col("value_lod")
    return cells.agg(
        F.count_if(z.isNull() != v.isNull()).alias("one_series_only"),
        F.count_if(z > v + tolerance).alias("zero_above_limit"),
        F.count_if((F.col("n_censored") == 0) & (F.abs(z - v) > tolerance)).alias("differ_uncensored"),
        F.count_if(F.col("n_censored") + F.col("n_not_detected") > F.col("n")).alias("more_than_n"),
        F.count_if((F.col("n_not_detected") == F.col("n")) & z.isNotNull()).alias("value_without_detection"),
    )


def guard(name: str, violations: DataFrame, most: int = 5) -> None:
    """Raises with some of the violations, if there are any."""
    found = violations.limit(most).collect()
    if found:
        raise ValueError(f"{name}: {[r.asDict() for r in found]}")


def misshapen_cells(cells: DataFrame, grains: list[str]) -> DataFrame:
    """Counts of occurrence cells whose period doesn't have the bounds of its grain, in one pass."""
    start, end = F.col("period_start"), F.col("period_end")
    year, month = F.substring(start, 1, 4), F.substring(start, 1, 7)
    is_ = lambda g: F.col("grain") == g
    last = F.last_day(F.to_date(F.concat(month, F.lit("-01")))).cast("string")
    return cells.agg(
        F.count_if(~F.col("grain").isin(*grains)).alias("other_grain"),
        F.count_if(is_("year") & ((start != F.concat(year, F.lit("-01-01"))) | (end != F.concat(year, F.lit("-12-31"))))).alias("not_a_year"),
        F.count_if(is_("survey_period") & (year == F.substring(end, 1, 4))).alias("within_a_year"),
        F.count_if(is_("month") & ((start != F.concat(month, F.lit("-01"))) | (end != last))).alias("not_a_month"),
    )


def months_unlike_years(cells: DataFrame, dims: list[str], bucket: Column) -> DataFrame:
    """Series and years (`bucket` of a month's first day, as text) in which roll-ups of months (input_grain 'month') differ from their months: in a count, in the least or greatest value, or because one side is missing."""
    keys = [*dims, "bucket", "stat"]
    values = [F.sum("n").alias("n"), F.sum("n_censored").alias("n_censored"), F.sum("n_not_detected").alias("n_not_detected")]
    extreme = lambda c: F.when(F.first("stat") == "min", F.min(c)).when(F.first("stat") == "max", F.max(c)).alias(c)
    from_month = cells.filter("input_grain = 'month'").withColumn("bucket", F.when(F.col("grain") == "month", bucket).otherwise(F.substring("period_start", 1, 4)))
    sides = []
    for rolled in (False, True):
        rows = from_month.filter((F.col("grain") != "month") if rolled else (F.col("grain") == "month") & (F.col("value_grain") != "month"))
        sides.append(rows.groupBy(*keys).agg(*values, extreme("value_zero"), extreme("value_lod")).select(*keys, F.struct("n", "n_censored", "n_not_detected", "value_zero", "value_lod").alias("rolled" if rolled else "months")))
    months, rolled = sides
    other = rolled.select(*(F.col(k).alias(f"r_{k}") for k in keys), "rolled")
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"r_{k}"))
    joined = months.join(other, on, "full_outer").filter(~F.col("months").eqNullSafe(F.col("rolled")))
    return joined.select(*(F.coalesce(k, f"r_{k}").alias(k) for k in keys), "months", "rolled")
