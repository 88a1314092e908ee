"""Record sets: what may be asked of a table, declared once, and a reader that adds a join only for a column that needs it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a page where none is asked for, and at most.
PAGE, LARGEST = 100, 1000


@dataclass(frozen=True)
class Lookup:
    """Another table that columns come from: its key, which must be unique there, the base table's column that names it, and the columns by alias. aggregate: rows by key, folded before the join."""

    table: str
    key: str
    by: str
    columns: dict[str, str]
    aggregate: bool = False


@dataclass(frozen=True)
class RecordSet:
    """A set of records.

    columns: alias to SQL expression over the base table; lookups: tables that are joined when one of their columns is chosen, tested, searched or
    sorted by; search: columns that a text is looked for in; ranges: numbers that a range may be asked of; source: the column that records are
    told apart by ('' if there is none), composite: its values are several names between bars; where: what always holds; geometry: a
    column that comes only when it is asked for.
    """

    table: str
    pk: str
    columns: dict[str, str]
    search: tuple[str, ...] = ()
    ranges: tuple[str, ...] = ()
    source: str = ""
    composite: bool = False
    where: str = ""
    geometry: str = ""
    lookups: tuple[Lookup, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)  # more columns over base and lookups together

    def known(self) -> dict[str, str]:
        return {**self.columns, **{a: a for x in self.lookups for a in x.columns}, **self.extra}

    def problems(self, tables: Callable[[str], DataFrame]) -> list[str]:
        """Names that the declaration gives and the tables don't have, or that it gives twice."""
        out = [f"{self.table}: no column {c}" for c in (self.pk, *self.search, *self.ranges, *([self.source] if self.source else [])) if c not in self.known()]
        aliases = [*self.columns, *(a for x in self.lookups for a in x.columns), *self.extra]
        out += [f"{self.table}: {a} twice" for a in sorted({a for a in aliases if aliases.count(a) > 1})]
        for name, expressions in ((self.table, self.columns), *((x.table, x.columns) for x in self.lookups)):
            folded = name != self.table and any(x.table == name and x.aggregate for x in self.lookups)
            try:
                found = [F.expr(e) for e in expressions.values()]
                _ = tables(name).agg(*found) if folded else tables(name).select(*found)
            except AnalysisException as e:
                out.append(f"{name}: {str(e).splitlines()[0]}")
        return out


def read(
    tables: Callable[[str], DataFrame], records: RecordSet, select: Iterable[str] | None = None, source: str | None = None, equal: dict | None = None, between: dict | None = None,
    id: object = None, after: object = None, text: str | None = None, order: Iterable[tuple[str, bool]] = (), geometry: bool = False, limit: int | None = PAGE, offset: int = 0, any_source: bool = False,
) -> DataFrame:
    """Records as asked for: chosen columns of those whose source, values, ranges, id and text fit, in order (column, descending; last by key), a page of them.

    Only declared columns can be named; a set with sources wants one unless any_source says otherwise; limit None: all. The base table is read
    with the columns that are used, and a lookup is joined only if one of its own is.
    """
    known = records.known()

    def check(name: str, among: Iterable[str] = known) -> str:
        if name not in among:
            raise ValueError(f"{records.table} has no {name} to ask for")
        return name

    chosen = [check(c) for c in (select if select is not None else known) if c != records.geometry]
    if geometry:
        if not records.geometry:
            raise ValueError(f"{records.table} has no geometry")
        chosen.append(records.geometry)
    if records.source and source is None and not any_source:
        raise ValueError(f"{records.table} is asked for by source")
    if not records.source and source is not None:
        raise ValueError(f"{records.table} has no sources")
    sorting = [(check(c), down) for c, down in order]
    sorting += [] if any(c == records.pk for c, _ in sorting) else [(records.pk, False)]
    tests: list[Column] = []
    if source is not None:
        c = F.col(records.source)
        tests.append(F.concat(F.lit("|"), c, F.lit("|")).contains(f"|{source}|") if records.composite else c == source)
    tests += [F.col(check(c)) == v for c, v in (equal or {}).items()]
    for c, (lo, hi) in (between or {}).items():
        if not all(isinstance(x, (int, float)) and abs(x) < float("inf") for x in (lo, hi)):
            raise ValueError(f"the range of {c} isn't of numbers")
        tests.append(F.col(check(c, records.ranges)).between(lo, hi))
    tests += [F.col(records.pk) == id] if id is not None else []
    tests += [F.col(records.pk) > after] if after is not None else []
    if text:
        low = [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in records.search]
        tests.append(F.greatest(*low, F.lit(False)) if low else F.lit(False))

    used = {*chosen, *(c for c, _ in sorting), records.pk, *(equal or {}), *(between or {})} | ({records.source} if source is not None else set()) | (set(records.search) if text else set())
    # A column over several tables needs all of their columns that it names.
    needed = used | {a for e in used & set(records.extra) for a in known if _names(records.extra[e], a)}
    rows = tables(records.table)
    rows = rows.filter(records.where) if records.where else rows
    joined = [x for x in records.lookups if needed & set(x.columns)]
    bases = {c: e for c, e in records.columns.items() if c in needed}
    rows = rows.select(*(F.expr(e).alias(c) for c, e in bases.items()), *(F.expr(x.by).alias(f"__by{i}") for i, x in enumerate(joined)))
    for i, x in enumerate(joined):
        own = {a: e for a, e in x.columns.items() if a in needed}
        there = tables(x.table)
        key = F.expr(x.key).alias(f"__key{i}")
        there = there.groupBy(key).agg(*(F.expr(e).alias(a) for a, e in own.items())) if x.aggregate else there.select(key, *(F.expr(e).alias(a) for a, e in own.items()))
        rows = rows.join(there, F.col(f"__by{i}") == F.col(f"__key{i}"), "left").drop(f"__by{i}", f"__key{i}")
    rows = rows.withColumns({a: F.expr(e) for a, e in records.extra.items() if a in needed})
    for test in tests:
        rows = rows.filter(test)
    if limit is not None or offset:
        rows = rows.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in sorting))
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(max(1, min(limit, LARGEST))) if limit is not None else rows
    return rows.select(*dict.fromkeys(chosen))


def _names(expression: str, name: str) -> bool:
    """Whether an expression names a column."""
    return re.search(rf"\b{re.escape(name)}\b", expression) is not None
