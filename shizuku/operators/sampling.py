"""Samples that are the same each time, samples with all they refer to, and rows recomputed another way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, strata: list[str], keys: list[str], each: int, seed: int = 1) -> DataFrame:
    """So many rows of every stratum, those whose keys hash lowest."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= each).drop("__rn")


def closure(rows: dict[str, DataFrame], seeds: dict[str, DataFrame], refs: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Seeds with every row that they refer to. refs: (table, column, target, key), in an order in which targets come after what refers to them."""
    out = dict(seeds)
    for table, column, target, key in refs:
        if table in out:
            needed = rows[target].join(out[table].select(F.col(column).alias(key)).distinct(), key, "left_semi").select(*rows[target].columns)
            out[target] = needed.unionByName(out[target]).distinct() if target in out else needed
    return out


def recomputed_means(facts: DataFrame, cells: DataFrame, keys: list[str], value: str, mean: str, tolerance: float = 1e-9) -> DataFrame:
    """Cells whose mean differs from an exactly rounded sum of their facts. Only the cells given, a sample, are recomputed."""

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [v for v in pdf[value] if v is not None and not math.isnan(v)]
        return pd.DataFrame([[*pdf[keys].iloc[0], math.fsum(values) / len(values) if values else None]], columns=[*keys, "exact"])

    kinds = dict(facts.dtypes)
    mine = facts.join(cells.select(*keys), keys, "left_semi")
    again = mine.groupBy(*keys).applyInPandas(exact, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", exact double")
    far = F.abs(F.col(mean) - F.col("exact")) > tolerance * F.greatest(F.abs("exact"), F.lit(1.0))
    return cells.join(again, keys, "left").filter(far | (F.col(mean).isNull() != F.col("exact").isNull()))


def snapshot(df: DataFrame, numbers: list[str]) -> dict:
    """Rows, sums to 12 significant digits and a hash that doesn't depend on order, for comparison between versions."""
    from shizuku.sources.tables import fingerprint

    sums = df.agg(*(F.sum(c).alias(c) for c in numbers)).first().asDict() if numbers else {}
    return fingerprint(df) | {"sums": {k: float(f"{v:.12g}") if v is not None else None for k, v in sums.items()}}


def degenerate(snapshots: Iterator[dict]) -> bool:
    """Whether runs of one query tell nothing: all empty, or at most one row each."""
    return all(s["rows"] <= 1 for s in snapshots)


def mapped_ids(rows: DataFrame, id_map: DataFrame, column: str) -> DataFrame:
    """Rows with old ids replaced by new ones; ids that the map doesn't have stay."""
    m = id_map.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    return rows.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")
