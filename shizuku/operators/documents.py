"""Checks of tables read from documents: totals against the sums of their parts, keys that repeat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _maximal(keys: list[str]) -> set[str]:
    """Keys that don't lie below another of them; a key is a path of parts between bars."""
    have = set(keys)

    def covered(key: str) -> bool:
        parts = key.split("|")
        return any("|".join(parts[:i]) in have for i in range(1, len(parts)))

    return {k for k in have if not covered(k)}


def total_failures(cells: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """doc_id, table_id, col_key, row_key, total, closest: totals that no scope's parts add up to.

    cells: doc_id, table_id, row_key, col_key, value double, is_total. A scope is a prefix of the total's path, the deepest first; its
    parts are the rows below it that no other such row contains. Each document table is one group, as large as a page.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches))
        out = []
        for col, items in table[table["value"].notna() & table["row_key"].notna() & (table["row_key"] != "")].groupby("col_key"):
            totals, parts = items[items["is_total"] == 1], items[items["is_total"] == 0]
            for key, total in zip(totals["row_key"], totals["value"], strict=True):
                path, best = key.split("|"), None
                for depth in range(len(path) - 1, -1, -1):
                    prefix = "|".join(path[:depth])
                    scope = parts[(parts["row_key"] != key) & parts["row_key"].str.startswith(prefix)]
                    if scope.empty:
                        continue
                    s = scope[scope["row_key"].isin(_maximal(scope["row_key"].tolist()))]["value"].sum()
                    error = abs(total - s) / max(abs(total), 1.0)
                    best = min((error, s), best or (error, s))
                    if error <= tolerance:
                        break
                if best and best[0] > tolerance:
                    out.append((table["doc_id"].iloc[0], table["table_id"].iloc[0], col, key, total, best[1]))
        yield pd.DataFrame(out, columns=["doc_id", "table_id", "col_key", "row_key", "total", "closest"])

    groups = cells.select("doc_id", "table_id", "row_key", "col_key", "value", "is_total").groupBy("doc_id", "table_id")
    return groups.applyInPandas(lambda pdf: next(check(iter([pdf]))), "doc_id string, table_id string, col_key string, row_key string, total double, closest double")


def repeated_cells(cells: DataFrame) -> DataFrame:
    return cells.filter("row_key IS NOT NULL AND col_key IS NOT NULL").groupBy("doc_id", "table_id", "row_key", "col_key").count().filter("count > 1")


def melt(wide: DataFrame, keys: list[str], name: str = "taxon", value: str = "reads") -> DataFrame:
    """A sheet of sites by taxa as long rows; blank cells are neither detections nor their absence."""
    columns = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).unpivot(keys, columns, name, value)
    return long.filter(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn(value, F.col(value).try_cast("double"))


def header_is_sound(cells: list[str | None]) -> bool:
    """At least two thirds of a header's cells hold a name."""
    good = sum(bool(c) and not c.replace(".", "").replace(",", "").isdigit() for c in cells)
    return bool(cells) and 3 * good >= 2 * len(cells)


def hourly_to_daily(wide: DataFrame, keys: list[str], hours: list[str], missing: tuple[float, ...] = (9998.0, 9999.0), circular: tuple[str, ...] = (), item: str = "item") -> DataFrame:
    """Days of 24 hourly columns: mean (3 digits), extremes, counts of valid and missing hours; items that are directions have no mean and are left out."""
    hour = [F.when(~F.col(h).cast("double").isin(*missing), F.col(h).cast("double")) for h in hours]
    rows = wide.filter(~F.col(item).isin(*circular)) if circular else wide
    rows = rows.select(*keys, F.filter(F.array(*hour), lambda x: x.isNotNull()).alias("v"))
    mean = F.when(F.size("v") > 0, F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v"), 3))
    return rows.select(*keys, mean.alias("mean"), F.array_min("v").alias("min"), F.array_max("v").alias("max"), F.size("v").alias("n_valid"), (len(hours) - F.size("v")).alias("n_missing"))


def samples_to_daily(long: DataFrame, keys: list[str]) -> DataFrame:
    """Samples within the hour (keys, stamp 'YYYY-MM-DDTHH:MM', value text) to days: repeats of a stamp count once, midnight belongs to the day before, marks for missing values are classed."""
    once = long.dropDuplicates([*keys, "stamp"])
    number = F.col("value").try_cast("double")
    day = F.when(F.substring("stamp", 12, 5) == "00:00", F.date_sub(F.to_date(F.substring("stamp", 1, 10)), 1)).otherwise(F.to_date(F.substring("stamp", 1, 10)))
    rows = once.withColumn("x", number).withColumn("day", day.cast("string"))
    gone = F.count_if(F.col("x").isNull() & F.col("value").isNotNull())
    return rows.groupBy(*keys, "day").agg(F.round(F.avg("x"), 3).alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.count("x").alias("n_obs"), gone.alias("n_marked"))


def last_record(rows: DataFrame, keys: list[str], year: str, attributes: list[str]) -> DataFrame:
    """The attributes of each key's latest year, with its first and last year and how many there are."""
    last = F.max(F.struct(year, *attributes)).alias("l")
    out = rows.groupBy(*keys).agg(last, F.min(year).alias("y_from"), F.max(year).alias("y_to"), F.countDistinct(year).alias("n_years"))
    return out.select(*keys, *(F.col(f"l.{a}") for a in attributes), "y_from", "y_to", "n_years")


def greatest_share(rows: DataFrame, keys: list[str], share: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(share).desc_nulls_last(), F.col(tie))
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")
