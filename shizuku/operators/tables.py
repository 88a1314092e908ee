"""Reading one table for people: filters, pages, column statistics, guarded SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statements that a query may start with, and words that it may not hold.
STARTS = ("select", "with", "explain", "values")
FORBIDDEN = ["insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "pragma", "vacuum", "reindex", "truncate", "grant", "revoke", "merge", "load", "add", "set", "reset", "cache", "refresh", "use"]


def condition(df: DataFrame, column: str, op: str, value: str | None = None) -> Column | None:
    """One filter; null if the table has no such column. Values are read as the column's own type."""
    if column not in df.columns:
        return None
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if op == "isnull":
        return c.isNull() | (c.cast("string") == "")
    if op == "notnull":
        return c.isNotNull() & (c.cast("string") != "")
    if op in ("contains", "starts"):
        text, want = F.lower(c.cast("string")), str(value).lower()
        return text.contains(want) if op == "contains" else text.startswith(want)
    v = F.lit(value) if isinstance(kind, T.StringType) else F.lit(value).try_cast(kind)
    return {"=": c == v, "!=": ~c.eqNullSafe(v), ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]


def browse(df: DataFrame, filters: list[tuple[str, str, str | None]] = (), search: str = "", order: str | None = None, descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a table: all filters hold, and any text column has the search text."""
    for f in filters:
        test = condition(df, *f)
        if test is not None:
            df = df.filter(test)
    if search:
        texts = [F.lower(F.col(f"`{f.name}`")).contains(search.lower()) for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.filter(F.greatest(*texts, F.lit(False)) if texts else F.lit(False))
    if order in df.columns:
        c = F.col(f"`{order}`")
        df = df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), *(x for x in df.columns if x != order))
    return df.offset(offset).limit(limit)


def capped_count(df: DataFrame, cap: int = 200_000) -> tuple[int, bool]:
    """(rows up to the cap, whether that is all)."""
    n = df.limit(cap + 1).count()
    return min(n, cap), n <= cap


def page_after(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The page behind a key, with next_after in each row: null on the last page. One row more than a page is read."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    more = rows.orderBy(key).limit(limit + 1)
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(key))
    last = F.max(F.when(F.col("__place") == limit, F.col(key))).over(Window.partitionBy())
    out = more.withColumn("__n", n).withColumn("__place", place)
    return out.withColumn("next_after", F.when(F.col("__n") > limit, last)).filter(F.col("__place") <= limit).drop("__n", "__place")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, n_empty, n_distinct, smallest, largest of columns, in one pass over the table."""
    aggs = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        aggs.append(F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count_if(text.isNull() | (text == "")).alias("n_empty"), F.countDistinct(F.col(f"`{c}`")).alias("n_distinct"), F.min(F.col(f"`{c}`")).cast("string").alias("smallest"), F.max(F.col(f"`{c}`")).cast("string").alias("largest")))
    return df.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).count().orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(k)


def checked_sql(sql: str) -> str:
    """The one statement of a reader's SQL, or an error."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    plain = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "''", bare)
    if ";" in plain:
        raise ValueError("one statement only")
    words = re.findall(r"[a-z_]+", plain.lower())
    if not words or words[0] not in STARTS:
        raise ValueError("it must start with " + ", ".join(STARTS))
    if bad := [w for w in words if w in FORBIDDEN and not re.search(rf"\b{w}\s*\(", plain.lower())]:
        raise ValueError(f"not allowed: {bad[0]}")
    return bare


def run_sql(spark: SparkSession, sql: str, tables: set[str], most: int = 1000) -> tuple[DataFrame, bool]:
    """(at most so many rows, whether there were more) of a reader's query over known tables only."""
    bare = checked_sql(sql)
    df = spark.sql(bare)
    plan = df._jdf.queryExecution().logical().collectLeaves()
    seen = {str(x.group(1)) for i in range(plan.size()) if (x := re.search(r"UnresolvedRelation \[([^\]]+)\]", plan.apply(i).toString()))}
    if unknown := {s.replace(", ", ".").split(".")[-1] for s in seen} - tables:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    rows = df.limit(most + 1)
    return rows.limit(most), rows.count() > most
