"""Periods as closed intervals of local-time text: (grain, start, end) from labels and observation dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of an observation date, with the grain that each stands for.
SHAPES = [
    ("day", r"^\d{4}-\d{2}-\d{2}$", "day"),
    ("instant_second", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "instant"),
    ("instant_minute", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "instant"),
    ("day_interval", r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$", "survey_period"),
    ("year", r"^\d{4}$", "year"),
    ("month", r"^\d{4}-\d{2}$", "month"),
    ("year_interval", r"^\d{4}/\d{4}$", "survey_period"),
    ("instant_minute_z", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z$", "instant"),
    ("instant_millisecond_z", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$", "instant"),
    ("instant_second_z", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "instant"),
    ("instant_minute_z_interval", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z/\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z$", "survey_period"),
    ("month_interval", r"^\d{4}-\d{2}/\d{4}-\d{2}$", "survey_period"),
]
# First years of the Japanese eras, less one, so that era year + offset is the common year.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}


def month_end(month: Column) -> Column:
    """Last day of 'YYYY-MM'."""
    return F.last_day(F.to_date(F.concat(month, F.lit("-01")))).cast("string")


def fiscal_year_of(day: Column) -> Column:
    """The year in which the fiscal year, April to March, of a day 'YYYY-MM-DD' begins."""
    year, month = F.substring(day, 1, 4).cast("int"), F.substring(day, 6, 2).cast("int")
    return year - F.when(month < 4, 1).otherwise(0)


def year_bounds(year: Column) -> tuple[Column, Column]:
    y = F.lpad(year.cast("string"), 4, "0")
    return F.concat(y, F.lit("-01-01")), F.concat(y, F.lit("-12-31"))


def fiscal_bounds(year: Column) -> tuple[Column, Column]:
    y, z = F.lpad(year.cast("string"), 4, "0"), F.lpad((year + 1).cast("string"), 4, "0")
    return F.concat(y, F.lit("-04-01")), F.concat(z, F.lit("-03-31"))


def local_part(label: Column, offset: str = "+09:00") -> Column:
    """The first 19 characters of a label with its zone, which must be `offset`."""
    return F.when(F.substring(label, 20, 6) == offset, F.substring(label, 1, 19)).otherwise(F.raise_error(F.concat(F.lit("unexpected zone in "), label)).cast("string"))


def _stamp(text: Column) -> Column:
    return F.date_format(text, "yyyy-MM-dd'T'HH:mm:ss")


def hour_ending(label19: Column) -> tuple[Column, Column]:
    """The hour that ends at a label; the hour that ends at midnight begins on the day before."""
    return _stamp(F.to_timestamp(label19, "yyyy-MM-dd'T'HH:mm:ss") - F.expr("INTERVAL 1 HOUR")), label19


def label_period(label: Column, grain: Column, offset: str = "+09:00") -> Column:
    """struct(period_start, period_end) of a label of 4, 7, 10 or 25 characters; other lengths are errors."""
    size = F.length(label)
    year = F.substring(label, 1, 4).cast("int")
    (ys, ye), (fs, fe) = year_bounds(year), fiscal_bounds(year)
    local = local_part(label, offset)
    hs, he = hour_ending(local)
    bad = F.raise_error(F.concat(F.lit("no period of "), label)).cast("string")
    start = F.when((size == 4) & (grain == "fiscal_year"), fs).when(size == 4, ys).when(size == 7, F.concat(label, F.lit("-01"))).when(size == 10, label)
    end = F.when((size == 4) & (grain == "fiscal_year"), fe).when(size == 4, ye).when(size == 7, month_end(label)).when(size == 10, label)
    start = start.when((size == 25) & (grain == "hour"), hs).when(size == 25, local).otherwise(bad)
    end = end.when((size == 25) & (grain == "hour"), he).when(size == 25, local).otherwise(bad)
    return F.struct(start.alias("period_start"), end.alias("period_end"))


def shape_of(value: Column) -> Column:
    """The name of the one shape that fits an observation date; no shape is an error, null stays null."""
    out = None
    for name, pattern, _ in SHAPES:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return F.when(value.isNotNull(), out.otherwise(F.raise_error(F.concat(F.lit("unknown shape: "), value)).cast("string")))


def _to_local(label: Column, minutes: int) -> Column:
    """A label that ends in Z as local time to the second. Leaving the year is an error."""
    body = F.substring(F.concat(F.regexp_replace(label, "Z$", ""), F.when(F.length(label) == 17, ":00").otherwise("")), 1, 19)
    local = _stamp(F.to_timestamp(body, "yyyy-MM-dd'T'HH:mm:ss") + F.expr(f"INTERVAL {minutes} MINUTE"))
    same = F.substring(local, 1, 4) == F.substring(body, 1, 4)
    return F.when(same, local).otherwise(F.raise_error(F.concat(F.lit("leaves its year in local time: "), label)).cast("string"))


def with_observed_period(df: DataFrame, column: str, name: str, utc_offset_minutes: int = 540) -> DataFrame:
    """df with a struct(shape, period_grain, period_start, period_end) of an observation date. The shape is found once, in a step of its own."""
    shaped = df.withColumn("__shape", shape_of(F.col(column)))
    return shaped.withColumn(name, observed_period(F.col(column), F.col("__shape"), utc_offset_minutes)).drop("__shape")


def observed_period(value: Column, shape: Column, utc_offset_minutes: int = 540) -> Column:
    """struct(shape, period_grain, period_start, period_end) of an observation date whose shape is known."""
    left, right = F.split(value, "/")[0], F.get(F.split(value, "/"), F.lit(1))
    zoned = shape.isin("instant_minute_z", "instant_millisecond_z", "instant_second_z")
    start = (
        F.when(shape.isin("year", "year_interval"), F.concat(F.substring(left, 1, 4), F.lit("-01-01")))
        .when(shape.isin("month", "month_interval"), F.concat(left, F.lit("-01")))
        .when(shape.isin("day", "day_interval"), left)
        .when(shape == "instant_minute", F.concat(value, F.lit(":00")))
        .when(shape == "instant_second", value)
        .when(zoned | (shape == "instant_minute_z_interval"), _to_local(left, utc_offset_minutes))
    )
    end = (
        F.when(shape == "year", F.concat(value, F.lit("-12-31")))
        .when(shape == "year_interval", F.concat(right, F.lit("-12-31")))
        .when(shape == "month", month_end(value))
        .when(shape == "month_interval", month_end(right))
        .when(shape == "day_interval", right)
        .when(shape == "instant_minute_z_interval", _to_local(right, utc_offset_minutes))
        .otherwise(start)
    )
    grain = None
    for name, _, g in SHAPES:
        grain = F.when(shape == name, g) if grain is None else grain.when(shape == name, g)
    ordered = F.when(start <= end, end).otherwise(F.raise_error(F.concat(F.lit("ends before it starts: "), value)).cast("string"))
    return F.struct(shape.alias("shape"), grain.alias("period_grain"), start.alias("period_start"), F.when(value.isNotNull(), ordered).alias("period_end"))


def era_year(text: Column) -> Column:
    """The common year of 'era n年' or of four digits; null if neither is there. '元' is year 1."""
    era, number = F.regexp_extract(text, "(" + "|".join(ERAS) + r")\s*(\d+|元)", 1), F.regexp_extract(text, "(?:" + "|".join(ERAS) + r")\s*(\d+|元)", 1)
    base = None
    for name, before in ERAS.items():
        base = F.when(era == name, before) if base is None else base.when(era == name, before)
    four = F.regexp_extract(text, r"(\d{4})", 1)
    return F.when(era != "", base + F.when(number == "元", 1).otherwise(number.try_cast("int"))).when(four != "", four.try_cast("int"))


def era_month(text: Column) -> Column:
    """'YYYY-MM' of a label with an era or common year and a month."""
    month = F.regexp_extract(text, r"(\d{1,2})\s*月", 1)
    return F.when(month != "", F.concat_ws("-", F.lpad(era_year(text).cast("string"), 4, "0"), F.lpad(month, 2, "0")))


def era_fiscal_year(text: Column) -> Column:
    """The fiscal year that a label names ('令和5年度', '2023年度')."""
    return F.when(text.contains("年度") | text.rlike(r"^\d{4}$"), era_year(text))
