"""Building registries: votes, ties, latest records, aliases, red-list categories."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, n_ties: the most frequent value; ties go to the smaller, null last, and are counted."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value).isNull(), F.col(value))
    most = F.max("n").over(Window.partitionBy(*keys))
    ties = F.count_if(F.col("n") == F.col("most")).over(Window.partitionBy(*keys))
    out = n.withColumn("most", most).withColumn("n_ties", ties).withColumn("rn", F.row_number().over(order))
    return out.filter("rn = 1").drop("rn", "most")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in `order`."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: str = "replace", order: list[str] | None = None) -> DataFrame:
    """old with new: 'replace' lets new rows win, 'ignore' old ones. Null keys match one another.

    Of new rows with one key, 'replace' keeps the last and 'ignore' the first in `order` (columns that tell when a row came);
    of those that came together, or without `order`, the first by all columns.
    """
    came = [F.col(c).desc_nulls_last() if policy == "replace" else F.col(c).asc_nulls_first() for c in order or []]
    rank = Window.partitionBy(*keys).orderBy(*came, *new.columns)
    new = new.withColumn("__rn", F.row_number().over(rank)).filter("__rn = 1").drop("__rn")
    missing = lambda rows, from_: rows.join(from_.select(*(F.col(k).alias(f"__{k}") for k in keys)), reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_anti")
    return missing(old, new).unionByName(new) if policy == "replace" else old.unionByName(missing(new, old))


def with_alias(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (dataset, alias, source_id) with variable_id of the alias; an alias without source holds for rows without source only."""
    a = aliases.select(F.col("dataset").alias("a_dataset"), F.col("alias").alias("a_alias"), F.col("source_id").alias("a_source"), "variable_id")
    on = (F.col("dataset") == F.col("a_dataset")) & (F.col("alias") == F.col("a_alias")) & F.col("source_id").eqNullSafe(F.col("a_source"))
    return rows.join(a, on, "left").drop("a_dataset", "a_alias", "a_source")


def red_list(taxa: DataFrame, assessments: DataFrame, severity: list[str]) -> DataFrame:
    """taxa (name) with category and how it was found: the prefecture's list by exact name, else the national list, else a subspecies' (newest, most severe, by name).

    assessments: name, scope ('pref', 'national'), year, category.
    """
    rank = F.array_position(F.array(*map(F.lit, severity)), F.col("category"))
    newest = latest(assessments, ["name", "scope"], [F.col("year").desc(), rank, F.col("category")])
    pref = newest.filter("scope = 'pref'").select("name", F.col("category").alias("pref"))
    nat = newest.filter("scope = 'national'").select("name", F.col("category").alias("nat"))
    sub = assessments.withColumn("species", F.substring_index("name", " ", 2)).filter("species <> name")
    sub = latest(sub, ["species"], [F.col("year").desc(), rank, F.col("name")]).select(F.col("species").alias("name"), F.col("category").alias("sub"))
    out = taxa.join(pref, "name", "left").join(nat, "name", "left").join(sub, "name", "left")
    how = F.when(F.col("pref").isNotNull(), "pref_exact").when(F.col("nat").isNotNull(), "national_exact").when(F.col("sub").isNotNull(), "subspecies")
    return out.select(*taxa.columns, F.coalesce("pref", "nat", "sub").alias("category"), how.alias("method"))


def excluded(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """df with the first reason, in order, for which a row doesn't count; null for those that do."""
    return df.withColumn("excluded_by", F.coalesce(*(F.when(test, name) for name, test in reasons)))
