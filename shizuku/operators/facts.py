"""The scan that makes facts of raw rows: their references resolved by left joins in one pass, and every row that can't be used with its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """Something that rows refer to: its table, the pairs (column of the rows, column of the table) that must be equal, null to null, the columns that it gives by alias, and whether a row without it is rejected."""

    name: str
    table: DataFrame
    on: tuple[tuple[str, str], ...]
    columns: tuple[tuple[str, str], ...]
    required: bool = True


def resolved(rows: DataFrame, references: list[Reference], tests: list[tuple[str, Column]] = ()) -> DataFrame:
    """rows with the columns of their references and `rejected`, the sorted names of required references that aren't there and of tests that don't hold.

    Every row comes out once: joins are left joins, and a reference that has two rows for one key is an error, not two facts. Tests are conditions on rows
    with their references; null counts as not holding. Accepted rows are those with an empty `rejected`; `reasons` counts the others.
    """
    out, reasons = rows, []
    for i, r in enumerate(references):
        keys = [F.col(there).alias(f"__k{i}_{j}") for j, (_, there) in enumerate(r.on)]
        given = F.struct(F.lit(True).alias("there"), *(F.col(c).alias(a) for a, c in r.columns))
        one = r.table.groupBy(*keys).agg(F.count("*").alias(f"__n{i}"), F.first(given).alias(f"__v{i}"))
        twice = F.raise_error(F.concat(F.lit(f"{r.name} has several rows for "), F.to_json(F.struct(*(F.col(f"__k{i}_{j}") for j in range(len(r.on)))))))
        one = one.withColumn(f"__v{i}", F.when(F.col(f"__n{i}") > 1, twice.cast(one.schema[f"__v{i}"].dataType)).otherwise(F.col(f"__v{i}"))).drop(f"__n{i}")
        same = F.lit(True)
        for j, (here, _) in enumerate(r.on):
            same = same & F.col(here).eqNullSafe(F.col(f"__k{i}_{j}"))
        out = out.join(one, same, "left").drop(*(f"__k{i}_{j}" for j in range(len(r.on))))
        if r.required:
            reasons.append(F.when(F.col(f"__v{i}").isNull(), F.lit(r.name)))
        out = out.withColumns({a: F.col(f"__v{i}.{a}") for a, _ in r.columns})
    reasons += [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests]
    listed = F.array_sort(F.array_compact(F.array(*reasons))) if reasons else F.array().cast("array<string>")
    return out.withColumn("rejected", listed).drop(*(f"__v{i}" for i in range(len(references))))


def accepted(found: DataFrame) -> DataFrame:
    return found.filter(F.size("rejected") == 0).drop("rejected")


def reasons(found: DataFrame) -> DataFrame:
    """reason, n of the rejected rows; a row with several reasons counts for each of them."""
    return found.select(F.explode("rejected").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def conserved(rows: DataFrame, found: DataFrame) -> DataFrame:
    """given, accepted, rejected: the rows that went in and those that came out; `held` says whether none is lost or doubled and any is there."""
    out = found.agg(F.count_if(F.size("rejected") == 0).alias("accepted"), F.count_if(F.size("rejected") > 0).alias("rejected"))
    counts = rows.agg(F.count("*").alias("given")).join(F.broadcast(out))  # a row each
    return counts.withColumn("held", (F.col("given") == F.col("accepted") + F.col("rejected")) & (F.col("given") > 0))
