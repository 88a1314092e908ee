"""The occurrence cube: counts of biological records by place, taxon and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shizuku.functions import periods

DIMS = ["region_id", "source_id", "place_id", "taxon_id"]


def located(occurrence: DataFrame) -> DataFrame:
    """The records with a date and coordinates, at their grid cell."""
    return occurrence.filter("period_raw IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").withColumn("place_kind", F.lit("grid01"))


def watershed(occurrence: DataFrame, places: DataFrame) -> DataFrame:
    """All dated records at their watershed, which may be none."""
    at = places.filter(F.col("place_kind") == "watershed").select("record_id", F.col("place_id").alias("w"))
    return occurrence.filter("period_raw IS NOT NULL").join(at, "record_id").withColumn("place_id", F.col("w")).withColumn("place_kind", F.lit("watershed")).drop("w")


def _measures():
    red = F.col("red_list_category").isNotNull() & (F.col("red_list_category") != "")
    return F.count("*").alias("n"), F.count_if(red).alias("n_red_list"), F.sum("is_alien_in_scope").cast("long").alias("n_alien")


def cells(population: DataFrame, grain: str) -> DataFrame:
    """'year': periods within one year; 'survey_period': those across years, as they are; 'month': those within one month."""
    start, end = F.col("period_start"), F.col("period_end")
    if grain == "year":
        rows, keys = population.filter(F.substring(start, 1, 4) == F.substring(end, 1, 4)), [F.substring(start, 1, 4).alias("p")]
    elif grain == "month":
        rows, keys = population.filter(F.substring(start, 1, 7) == F.substring(end, 1, 7)), [F.substring(start, 1, 7).alias("p")]
    else:
        rows, keys = population.filter(F.substring(start, 1, 4) != F.substring(end, 1, 4)), ["period_start", "period_end"]
    out = rows.groupBy(*DIMS, "place_kind", *keys).agg(*_measures()).withColumn("grain", F.lit(grain))
    if grain == "year":
        first, last = periods.year_bounds(F.col("p"))
        out = out.withColumn("period_start", first).withColumn("period_end", last)
    elif grain == "month":
        out = out.withColumn("period_start", F.concat("p", F.lit("-01"))).withColumn("period_end", periods.month_end(F.col("p")))
    return out.select(*DIMS, "place_kind", "grain", "period_start", "period_end", "n", "n_red_list", "n_alien")


def cube(occurrence: DataFrame, places: DataFrame) -> DataFrame:
    """Both populations by year and survey period, located records by month as well."""
    here, there = located(occurrence), watershed(occurrence, places)
    parts = [cells(p, g) for p in (here, there) for g in ("year", "survey_period")] + [cells(here, "month")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def from_sources(cells: DataFrame, sources: list[str] | None) -> DataFrame:
    """Cells of some sources; None stands for all, an empty list for none."""
    return cells if sources is None else cells.filter(F.col("source_id").isin(*sources) if sources else F.lit(False))


def scoped_species(cells: DataFrame, places: list[str] | None = None, years: tuple[int, int] | None = None, sources: list[str] | None = None, group: str | None = None, red_listed: bool = False) -> DataFrame:
    """The species catalog counted anew for a scope: species with n, n_red_list, places, first and last year. cells: with binom, taxon_group and year, of one kind of place."""
    rows = from_sources(cells.filter("binom IS NOT NULL"), sources)
    rows = rows.filter(F.col("place_id").isin(*places) if places else F.lit(False)) if places is not None else rows
    rows = rows.filter(F.col("year").between(*years)) if years else rows
    out = rows.groupBy("binom").agg(F.max("taxon_group").alias("taxon_group"), F.sum("n").alias("n"), F.sum("n_red_list").alias("n_red_list"), F.count_distinct("place_id").alias("n_places"), F.min("year").alias("y_from"), F.max("year").alias("y_to"))
    out = out.filter(F.col("taxon_group") == group) if group else out
    return out.filter("n_red_list > 0") if red_listed else out


def unlocated_years(cells: DataFrame) -> DataFrame:
    """Species, years and sources of which not all records have coordinates: n at watersheds, n_located in grid cells, and the grid cells, null without any."""
    here, there = F.col("place_kind") == "grid01", F.col("place_kind") == "watershed"
    rows = cells.filter("binom IS NOT NULL").groupBy("binom", "year", "source_id")
    mesh = F.count_distinct(F.when(here, F.col("place_id")))
    out = rows.agg(F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n_located"), F.nullif(mesh, F.lit(0)).alias("mesh"))
    return out.filter("n <> n_located")
