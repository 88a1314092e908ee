"""Reading the observation cube: a specification of cells lowered to one chain of filters and semi-joins."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shizuku.functions import naming
from shizuku.sources.stored import scratch_dir

KEY = ["variable_id", "value_grain", "obs_stat", "unit_id"]


@dataclass(frozen=True)
class CellSpec:
    """What to read. Periods are compared as text and include both ends; an empty list of places or sources means no rows, None all."""

    grains: tuple[str, ...] = ("year",)
    stats: tuple[str, ...] = ("mean",)
    variable_id: str | None = None
    series: tuple[tuple, ...] | None = None
    scope: tuple = ("all_sites",)
    region_id: str | None = None
    input_grains: tuple[str, ...] | None = None
    source_grain_only: bool = False
    period: tuple[str | None, str | None] = (None, None)
    limit: int | None = None


def _places(scope: tuple, tables: dict[str, DataFrame]) -> DataFrame | None:
    """place_id of a scope: ('places', ids), ('site', id), ('water', municipality), ('zone', ids), ('watershed', ids), ('all_sites',)."""
    kind, *rest = scope
    if kind == "all_sites":
        return None
    ids = rest[0]
    if kind == "water":
        return tables["site"].filter(F.col("municipality") == ids).select("place_id")
    if kind == "zone":
        return tables["place_relation"].filter((F.col("relation") == "within") & F.col("parent_id").isin(*ids)).select(F.col("child_id").alias("place_id")).distinct()
    spark = next(iter(tables.values())).sparkSession if tables else None
    values = [ids] if kind == "site" else list(ids)
    return spark.createDataFrame([(v,) for v in values], "place_id string")


def chosen(rows: DataFrame, spec: CellSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of the places, series and sources of a specification. These are keys of cells, so facts can be chosen before they are folded into cells."""
    if spec.scope[0] != "watershed":
        rows = rows.filter("place_kind = 'site'")
    if spec.scope[0] == "places" and not spec.scope[1]:
        return rows.filter(F.lit(False))
    if spec.variable_id is not None:
        rows = rows.filter(F.col("variable_id") == spec.variable_id)
    if spec.series is not None:
        # The variable alone is a filter that reaches the scan; the whole key then meets a few rows.
        rows = rows.filter(F.col("variable_id").isin(*{s[0] for s in spec.series}))
        keys = rows.sparkSession.createDataFrame([tuple(s) for s in spec.series], ", ".join(f"k_{c} string" for c in KEY))  # no more than the caller lists
        rows = rows.join(F.broadcast(keys), naming.all_of([F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY]), "left_semi")
    if spec.region_id is not None:
        rows = rows.filter(F.col("region_id") == spec.region_id)
    if spec.input_grains is not None:
        rows = rows.filter(F.col("input_grain").isin(*spec.input_grains))
    places = _places(spec.scope, tables)
    return rows if places is None else rows.join(places, "place_id", "left_semi")


def cells(cube: DataFrame, spec: CellSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """The cells of a specification, in a fixed order if limited; `limit` reads one row more, so that callers see whether there are more."""
    return of_grain(chosen(cube, spec, tables), spec)


def of_grain(found: DataFrame, spec: CellSpec) -> DataFrame:
    """Of the chosen cells those of the specification's grains, statistics and period, limited as it says."""
    rows = found.filter(F.col("grain").isin(*spec.grains) & F.col("stat").isin(*spec.stats))
    if spec.source_grain_only:
        rows = rows.filter(naming.at_source_grain(F.col("grain"), F.col("input_grain")))
    first, last = spec.period
    rows = rows.filter(F.col("period_start") >= first) if first is not None else rows
    rows = rows.filter(F.col("period_start") <= last) if last is not None else rows
    if spec.limit is None:
        return rows
    return rows.orderBy("place_id", "period_start", "stat", *(F.col(c).asc_nulls_first() for c in KEY)).limit(spec.limit + 1)


def default_basis(found: DataFrame) -> DataFrame:
    """Each place's and variable's best basis: days, else fiscal years, else years."""
    rank = F.create_map(F.lit("day"), F.lit(0), F.lit("fiscal_year"), F.lit(1), F.lit("year"), F.lit(2))
    rows = found.withColumn("basis", naming.basis_of(F.col("grain"), F.col("input_grain")))
    return rows.groupBy("place_id", "variable_id").agg(F.min_by("basis", rank[F.col("basis")]).alias("basis"))


def pivot_stats(found: DataFrame, stats: tuple[str, ...] = ("mean", "min", "max")) -> DataFrame:
    """One row for a place and period with a column per statistic; two series in one slot are an error."""
    keys = ["place_id", "period_start", "period_end"]
    n = F.count_distinct(F.struct(*KEY))
    alone = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit("two series share a place and period")).cast("boolean"))
    wide = found.groupBy(*keys).agg(alone.alias("alone"), *(F.max(F.when(F.col("stat") == s, F.col("value_zero"))).alias(s) for s in stats), F.max("n").alias("n"))
    return wide.filter("alone").drop("alone")


def evenly(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most so many rows, evenly spaced in order, first and last among them.

    Rows get their place in two levels: the sorted table is written with the partition of each row and its place there, then rows are
    numbered from those of the partitions before on. Only the counts, a row a partition, go through one window.
    """
    if most < 1:
        return df.limit(0)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % (1 << 33))
    path = f"{scratch_dir(df.sparkSession)}/shizuku-sorted/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__size"))
    sizes = sizes.select(F.col("__p").alias("__q"), (F.sum("__size").over(Window.orderBy("__p")) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy()).alias("__n"))
    rows = rows.join(F.broadcast(sizes), F.col("__p") == F.col("__q")).withColumn("__at", F.col("__before") + F.col("__i"))
    # The k-th of m picks stands at round(k * (n - 1) / (m - 1)). Of a place only the picks beside place * (m - 1) / (n - 1) can stand there, so a row costs the same however many there are.
    n, last = F.col("__n"), F.least(F.lit(most), F.col("__n")) - 1
    below = F.floor(F.col("__at") * last / F.greatest(n - 1, F.lit(1)))
    stands = [(k >= 0) & (k <= last) & (F.round(k * (n - 1) / F.greatest(last, F.lit(1))).cast("long") == F.col("__at")) for k in (below - 1, below, below + 1)]
    return rows.filter(reduce(or_, stands)).select(*df.columns)
