"""A lattice of stored roll-ups and a router that answers requests from the smallest of them.

The finest level holds cells as they come. Every other level holds, for its keys, measures that add up: of each value the exact sum (as
decimals), the number of values, the least and the greatest; the number of cells; sums of the counts; the first and the last day;
and, where it has dropped a key that requests count, how many different ones there were. A request names keys and measures. Every
level whose keys hold what the request needs, by themselves or as parts of a date, can answer it, and all give the same
answer to the last digit, because sums are exact. The router takes the one of fewest rows.

Levels that keep the part column, the year, are refreshed part by part: when facts change, only the years that changed are read,
rolled up and written; levels without it are rolled up again from the smallest level that has been refreshed. Each level is a
table in parts (`sources.parted`), so readers see it before or after a refresh, never in between.

A lattice can also hold its finest cells as a DataFrame, with nothing stored. It then answers every request from them in the pass that makes
them; requests for numbers of rows, different keys and first and last days, which add up over the rows of cells as well, don't fold the rows into cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shizuku.sources.parted import Parted

#: Parts of a date: what each is cut from, and the cut's place and length.
PERIODS = {"month": ("period_start", 1, 7), "year": ("period_start", 1, 4), "month_of_year": ("period_start", 6, 2)}
#: What the shorter parts can also be cut from.
_FROM_MONTH = {"year": (1, 4), "month_of_year": (6, 2)}
_DECIMAL = "decimal(38,9)"
_WHOLE = "all"
#: Measures that are the same over cells and over the rows that cells fold.
_OVER_ROWS = {"total", "distinct", "first", "last"}


@dataclass(frozen=True)
class Level:
    """Keys of a level. distinct: keys that it doesn't keep, whose different values it counts."""

    name: str
    keys: tuple[str, ...]
    distinct: tuple[str, ...] = ()


def cut(name: str, keys: Iterable[str]) -> Column | None:
    """A key, or a part of a date, from the keys there are; None if they don't hold it."""
    if name in keys:
        return F.col(name)
    if name in PERIODS and "period_start" in keys:
        return F.substring("period_start", *PERIODS[name][1:])
    if name in _FROM_MONTH and "month" in keys:
        return F.substring("month", *_FROM_MONTH[name])
    return None


@dataclass
class Lattice:
    """Levels under a path. values: columns of cells with sums and extremes; counts: columns of whole numbers that add up; part: the key that parts are made by.

    made: the finest cells, where nothing is stored; loose: the rows that they fold, each with the keys of its cell and what it adds to the counts.
    """

    spark: SparkSession
    path: str
    base: Level
    levels: tuple[Level, ...]
    values: tuple[str, ...]
    counts: tuple[str, ...]
    part: str = "year"
    made: DataFrame | None = field(default=None, repr=False)
    loose: DataFrame | None = field(default=None, repr=False)
    _tables: dict = field(default_factory=dict, repr=False)

    def table(self, name: str) -> Parted:
        return self._tables.setdefault(name, Parted(self.spark, f"{self.path}/{name}"))

    def cells(self, wanted: Callable[[str], bool] | None = None) -> DataFrame:
        """The finest level, with the part column left out."""
        if self.made is not None:
            return self.made
        rows = self.table(self.base.name).read(wanted)
        return rows.drop(self.part) if self.part not in self.base.keys else rows

    def level(self, name: str) -> DataFrame:
        """A coarser level: as stored, or rolled up from the cells."""
        to = next(x for x in self.levels if x.name == name)
        return self.table(name).read() if self.made is None else self.rolled(self.lifted(self.made), self.base.keys, to)

    # Measures.

    def lifted(self, cells: DataFrame) -> DataFrame:
        """Cells with the measures that levels have."""
        each = [c for v in self.values for c in (F.round(v, 9).cast(_DECIMAL).alias(f"{v}_s"), F.when(F.col(v).isNotNull(), 1).otherwise(0).cast("long").alias(f"{v}_c"), F.col(v).alias(f"{v}_lo"), F.col(v).alias(f"{v}_hi"))]
        day = cut("period_start", self.base.keys)
        when = [day.alias("first"), day.alias("last")] if day is not None else []
        return cells.select(*self.base.keys, *each, *self.counts, F.lit(1).cast("long").alias("cells"), *when)

    def _folds(self, dated: bool) -> list[Column]:
        sums = [F.sum(c).cast(_DECIMAL if c.endswith("_s") else "long").alias(c) for c in [*(f"{v}_{x}" for v in self.values for x in "sc"), *self.counts, "cells"]]
        ends = [f(f"{v}_{x}").alias(f"{v}_{x}") for v in self.values for x, f in (("lo", F.min), ("hi", F.max))]
        return sums + ends + ([F.min("first").alias("first"), F.max("last").alias("last")] if dated else [])

    def rolled(self, rows: DataFrame, own: tuple[str, ...], to: Level) -> DataFrame:
        """A level from the measures of a finer one with keys `own`."""
        keys = [cut(k, own).alias(k) for k in to.keys]
        return rows.groupBy(*keys).agg(*self._folds("first" in rows.columns), *(F.countDistinct(k).alias(f"d_{k}") for k in to.distinct))

    # Storing.

    def refresh(self, make: Callable[[list[str]], DataFrame], marks: dict[str, str], state: str) -> dict[str, list[str]]:
        """Brings all levels to the facts with these marks by part. make(parts): the cells of these parts. Returns what was written for each level."""
        base = self.table(self.base.name)
        full = lambda parts: make(parts).withColumn(self.part, cut(self.part, self.base.keys))
        done = {self.base.name: base.replace(full, self.part, marks, state, sort_by=[k for k in self.base.keys if k != self.part])}
        for level in self.levels:
            own = self.table(level.name)
            if self.part in level.keys or cut(self.part, level.keys) is not None:
                done[level.name] = own.replace(lambda parts, to=level: self._level_parts(to, parts), self.part, marks, state)
            else:
                # One part, whose mark is that of everything.
                whole = {_WHOLE: "; ".join(f"{p} {marks[p]}" for p in sorted(marks))}
                done[level.name] = own.replace(lambda _, to=level: self._whole(to), "__all", whole, state)
        return done

    def _finer(self, to: Level) -> Level:
        """The smallest level already refreshed that `to` can be made of."""
        ready = [x for x in (self.base, *self.levels[: self.levels.index(to)]) if all(cut(k, x.keys) is not None for k in (*to.keys, *to.distinct))]
        return min(ready, key=lambda x: self.table(x.name).rows())

    def _measures(self, level: Level, wanted: Callable[[str], bool] | None = None) -> DataFrame:
        rows = self.made if self.made is not None else self.table(level.name).read(wanted)
        return self.lifted(rows) if level is self.base else rows

    def _level_parts(self, to: Level, parts: list[str]) -> DataFrame:
        finer = self._finer(to)
        by_part = cut(self.part, finer.keys) is not None
        rows = self._measures(finer, (lambda p: p in parts) if by_part else None)
        out = self.rolled(rows, finer.keys, to)
        return out if self.part in to.keys else out.withColumn(self.part, cut(self.part, to.keys))

    def _whole(self, to: Level) -> DataFrame:
        finer = self._finer(to)
        return self.rolled(self._measures(finer), finer.keys, to).withColumn("__all", F.lit(_WHOLE))

    # Answering.

    def able(self, keys: Iterable[str], measures: dict[str, tuple], uses: Iterable[str] = ()) -> list[Level]:
        """Levels that can answer, those of fewest rows first. Where nothing is stored, that's the finest one or none."""
        need = {*keys, *uses}
        counted = {m[1] for m in measures.values() if m[0] == "distinct"}
        out = []
        for x in (self.base, *(self.levels if self.made is None else ())):
            fits = all(cut(k, x.keys) is not None for k in need)
            # A number of different ones holds for the level's own keys only.
            as_stored = counted <= set(x.distinct) and set(x.keys) == set(keys) and x is not self.base
            if fits and (as_stored or all(cut(k, x.keys) is not None for k in counted)):
                out.append(x)
        return sorted(out, key=lambda x: self.table(x.name).rows()) if self.made is None else out

    def answer(self, keys: Iterable[str], measures: dict[str, tuple], where: str | None = None, uses: Iterable[str] = (), level: Level | None = None) -> DataFrame:
        """keys and measures, by alias: ("mean" | "sum" | "min" | "max", value), ("count",) of cells, ("total", count), ("distinct", key), ("first",), ("last",).

        where: an SQL condition on the columns `uses`, keys or parts of dates. level: that one instead of the router's choice.
        """
        keys, uses = list(keys), list(uses)
        fit = self.able(keys, measures, uses)
        if not fit:
            raise ValueError(f"no level holds {sorted({*keys, *uses})}")
        at = level or fit[0]
        if at not in fit:
            raise ValueError(f"the level {at.name} doesn't hold the request")
        if self.loose is not None and {m[0] for m in measures.values()} <= _OVER_ROWS:
            day = cut("period_start", self.base.keys)
            rows = self.loose if day is None else self.loose.withColumns({"first": day, "last": day})
        else:
            rows = self._measures(at)
        cuts = {k: cut(k, at.keys) for k in dict.fromkeys([*keys, *uses])}
        rows = rows.withColumns({k: c for k, c in cuts.items() if k not in at.keys})
        rows = rows.filter(where) if where else rows
        stored = set(at.keys) == set(keys)

        def measure(kind: str, name: str = "") -> Column:
            if kind == "mean":
                return F.sum(f"{name}_s").cast("double") / F.sum(f"{name}_c")
            if kind == "sum":
                return F.sum(f"{name}_s").cast("double")
            if kind in ("min", "max"):
                return F.min(f"{name}_lo") if kind == "min" else F.max(f"{name}_hi")
            if kind == "distinct":
                return F.max(f"d_{name}") if stored and name in at.distinct and at is not self.base else F.countDistinct(cut(name, at.keys))
            return {"count": F.sum("cells"), "total": F.sum(name) if name else None, "first": F.min("first") if "first" in rows.columns else None, "last": F.max("last") if "last" in rows.columns else None}[kind]

        return rows.groupBy(*keys).agg(*(measure(*m).alias(a) for a, m in measures.items()))
