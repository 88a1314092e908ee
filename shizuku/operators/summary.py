"""Declarative summary tables: a closed vocabulary of filters, columns and measures, compiled to one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"sum", "count_distinct", "min", "max", "avg"}
EXPRESSIONS = {"year_of_period_start": lambda: F.substring("period_start", 1, 4).cast("int")}
CONDITIONS = {"year_between", "positive", "place_kind"}


def check(name: str, spec: dict, columns: dict[str, set[str]]) -> None:
    """Raises before any plan is made if a spec names what isn't there. columns: by table."""
    known = set(columns[spec["source"]]) | {f"{t}.{c}" for t in spec.get("join", {}) for c in columns[t]}

    def column(x: str) -> None:
        if x not in known and x not in spec.get("columns", {}):
            raise ValueError(f"{name}: no column {x}")

    for extra in set(spec) - {"source", "join", "filter", "columns", "group_by", "measures", "key", "by_region"}:
        raise ValueError(f"{name}: unknown entry {extra}")
    for x in [*spec["group_by"], *spec.get("filter", {})]:
        column(x)
    if set(spec["key"]) != set(spec["group_by"]):
        raise ValueError(f"{name}: the key isn't the grouping")
    for c in [*spec.get("columns", {}).values(), *spec["measures"].values()]:
        if ("col" in c) == ("expr" in c):
            raise ValueError(f"{name}: one of col and expr")
        if "col" in c:
            column(c["col"])
        elif c["expr"] not in EXPRESSIONS:
            raise ValueError(f"{name}: unknown expression {c['expr']}")
    for m, c in spec["measures"].items():
        if c["fn"] not in FUNCTIONS or set(c.get("when", {})) - CONDITIONS:
            raise ValueError(f"{name}: measure {m}")
        if spec.get("by_region") and c["fn"] == "avg":
            raise ValueError(f"{name}: an average can't be folded back from regions")


def _column(c: str) -> Column:
    return F.col(c.replace(".", "__"))


def _value(c: dict) -> Column:
    v = EXPRESSIONS[c["expr"]]() if "expr" in c else _column(c["col"])
    return F.coalesce(v, F.lit(c["coalesce"])) if "coalesce" in c else v


def _condition(when: dict) -> Column:
    out = F.lit(True)
    for k, v in when.items():
        if k == "year_between":
            out &= EXPRESSIONS["year_of_period_start"]().between(*v)
        elif k == "positive":
            out &= _column(v) > 0
        else:
            out &= F.col(k) == v
    return out


def _measure(name: str, c: dict) -> Column:
    value = _value(c)
    if "when" in c:
        value = F.when(_condition(c["when"]), value)
        if c["fn"] == "sum":
            value = F.coalesce(value, F.lit(0))
    fn = {"sum": F.sum, "count_distinct": F.countDistinct, "min": F.min, "max": F.max, "avg": F.avg}[c["fn"]]
    return fn(value).alias(name)


def compile_summary(spec: dict, tables: dict[str, DataFrame], by_region: bool = False) -> DataFrame:
    """The summary as one aggregation over its source, which a registry may join on `<table>_id`."""
    rows = tables[spec["source"]]
    for table in spec.get("join", {}):
        side = tables[table]
        side = side.select(*(F.col(c).alias(f"{table}__{c}") for c in side.columns))
        rows = rows.join(side, F.col(f"{table}_id") == F.col(f"{table}__{table}_id"), "left")
    for c, want in spec.get("filter", {}).items():
        column = _column(c)
        if isinstance(want, dict):
            rows = rows.filter(column.isNotNull())
        else:
            rows = rows.filter(column.isin(*want) if isinstance(want, list) else column == want)
    for c, how in spec.get("columns", {}).items():
        rows = rows.withColumn(c, _value(how))
    keys = (["region_id"] if by_region else []) + spec["group_by"]
    return rows.groupBy(*keys).agg(*(_measure(m, c) for m, c in spec["measures"].items()))


def folds_back(whole: DataFrame, parts: DataFrame, spec: dict) -> DataFrame:
    """Rows of `whole` that its regions don't add up to: sums equal, extremes equal, distinct counts at most the regions' sum."""
    keys = spec["group_by"]
    how = {"sum": F.sum, "count_distinct": F.sum, "min": F.min, "max": F.max}
    folded = parts.groupBy(*(F.col(k).alias(f"k_{k}") for k in keys)).agg(*(how[c["fn"]](m).alias(f"f_{m}") for m, c in spec["measures"].items()))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    bad = F.lit(False)
    for m, c in spec["measures"].items():
        bad |= (F.col(m) > F.col(f"f_{m}")) if c["fn"] == "count_distinct" else ~F.col(m).eqNullSafe(F.col(f"f_{m}"))
    return whole.join(folded, same, "full_outer").filter(F.coalesce(bad, F.lit(True)))
