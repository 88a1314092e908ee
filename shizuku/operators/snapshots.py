"""Snapshots of queries' answers over a grid of parameters as one long table, and the cells in which two snapshots differ."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What names a cell of a snapshot.
CELL = ("query", "parameters", "row_key", "nth", "column_name")


def evenly(values: list, most: int) -> list:
    """At most so many values, spread evenly over the list, with both ends; one value is the first."""
    if most < 1:
        raise ValueError(f"{most} values of a domain")
    if len(values) <= most:
        return list(values)
    return [values[(2 * k * (len(values) - 1) + most - 1) // (2 * (most - 1))] for k in range(most)] if most > 1 else values[:1]


def grid(domains: dict[str, list], most: int) -> list[dict[str, Any]]:
    """All combinations of at most `most` values of every parameter's domain."""
    picked = [evenly(values, most) for values in domains.values()]
    return [dict(zip(domains, combination, strict=True)) for combination in itertools.product(*picked)]


def cells(answer: DataFrame, query: str, parameters: dict[str, Any], keys: list[str]) -> DataFrame:
    """An answer's cells: CELL, the value as text and, of floating-point columns, as a number. Rows are named by their keys as JSON;
    rows of equal keys are numbered in order of all they hold, so that neither the order of rows nor the layout of files counts."""
    kinds = dict(answer.dtypes)
    values = [c for c in answer.columns if c not in keys]
    json_of = lambda names: F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    named = answer.withColumn("__key", json_of(keys)).withColumn("__all", json_of(answer.columns))
    numbered = named.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("__all")))
    number = lambda c: F.col(f"`{c}`").cast("double") if kinds[c] in ("float", "double") else F.lit(None).cast("double")
    text = lambda c: F.col(f"`{c}`").cast("string") if not kinds[c].startswith(("array", "map", "struct")) else F.when(F.col(f"`{c}`").isNotNull(), F.to_json(F.struct(F.col(f"`{c}`").alias("v"))))
    # A row without values is a cell of its own: that it is there.
    each = [F.struct(F.lit(c).alias("column_name"), text(c).alias("value"), number(c).alias("number")) for c in values] or [F.struct(F.lit("").alias("column_name"), F.lit("").alias("value"), F.lit(None).cast("double").alias("number"))]
    named_by = [F.lit(query).alias("query"), F.lit(json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str)).alias("parameters"), F.col("__key").alias("row_key"), F.col("__nth").alias("nth")]
    return numbered.select(*named_by, F.explode(F.array(*each)).alias("c")).select(*CELL[:4], "c.*")


def snapshot(query: str, run: Callable[..., DataFrame], parameters: list[dict[str, Any]], keys: list[str]) -> DataFrame:
    """The cells of a query's answers to all given parameters; `run` takes them by name."""
    if not parameters:
        raise ValueError(f"{query}: no parameters")
    return reduce(DataFrame.unionByName, (cells(run(**p), query, p, keys) for p in parameters))


def changes(before: DataFrame, after: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """CELL, kind (added, removed, changed), before and after of the cells that differ. Floating-point values differ beyond `tolerance`
    times the larger one; all others if their texts do, where null is a value like any other."""
    side = lambda df, name: df.select(*CELL, F.struct("value", "number").alias(name))
    both = side(before, "b").join(side(after, "a"), list(CELL), "full_outer")
    b, a = F.col("b.number"), F.col("a.number")
    near = F.coalesce(F.abs(b - a) <= tolerance * F.greatest(F.abs(b), F.abs(a)), F.lit(False))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("b.value").eqNullSafe(F.col("a.value")) & ~near, "changed")
    found = both.select(*CELL, kind.alias("kind"), F.col("b.value").alias("before"), F.col("a.value").alias("after"))
    return found.filter(F.col("kind").isNotNull())


def told_nothing(cells: DataFrame) -> DataFrame:
    """Queries whose answers never had more than one row, whatever the parameters: their snapshots prove little."""
    rows = cells.groupBy("query", "parameters").agg(F.countDistinct("row_key", "nth").alias("rows"))
    return rows.groupBy("query").agg(F.max("rows").alias("most_rows"), F.count("*").alias("answers")).filter("most_rows <= 1")
