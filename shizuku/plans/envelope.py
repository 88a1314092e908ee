"""Answers that describe themselves: rows with coverage, provenance, caveats and what was left out."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Envelope:
    query: dict[str, Any]
    rows: DataFrame
    columns: list[dict[str, str]]
    coverage: dict[str, Any]
    caveats: list[dict[str, Any]] = field(default_factory=list)
    excluded: list[dict[str, Any]] = field(default_factory=list)
    provenance: list[dict[str, Any]] = field(default_factory=list)
    truncated: bool = False


def coverage(cells: DataFrame) -> dict[str, Any]:
    """Places, period, censored and undetected values of the cells, in one pass."""
    row = cells.agg(F.countDistinct("place_id").alias("n_places"), F.min("period_start").alias("from"), F.max("period_start").alias("to"), F.sum("n").alias("n"), F.sum("n_censored").alias("n_censored"), F.sum("n_not_detected").alias("n_not_detected"), F.collect_set("unit_id").alias("units")).first()
    out = row.asDict()
    units = out.pop("units")
    return {k: v if v is not None or k in ("from", "to") else 0 for k, v in out.items()} | {"unit": units[0] if len(units) == 1 else None}


def build(query: dict[str, Any], cells: DataFrame, imputation: str = "zero", limit: int | None = None, caveats: DataFrame | None = None, excluded: DataFrame | None = None, sources: DataFrame | None = None) -> Envelope:
    """The envelope of cells read with one row more than `limit`."""
    found = coverage(cells)
    unit = {"unit": found["unit"]} if found["unit"] else {}
    values = ["value_zero", "value_lod"] if imputation == "both" else ["value"]
    rows = cells if imputation == "both" else cells.withColumn("value", F.col("value_lod" if imputation == "lod" else "value_zero"))
    truncated = limit is not None and cells.count() > limit
    rows = rows.select("place_id", "period_start", *values)
    rows = rows.limit(limit) if limit is not None else rows
    columns = [{"name": "place_id", "type": "string"}, {"name": "period_start", "type": "string"}, *({"name": v, "type": "number", **unit} for v in values)]
    listed = lambda df: [r.asDict() for r in df.collect()] if df is not None else []  # noqa: E731  a few rows each: notes, reasons, sources
    return Envelope(query, rows, columns, found, listed(caveats), listed(excluded), listed(sources), truncated)


def caveats_for(facets: DataFrame, scopes: DataFrame, caveats: DataFrame) -> DataFrame:
    """Caveats whose scope names one of the facets (order, kind, ref), each once, in order of its first facet, then by key."""
    hits = facets.join(scopes, ["kind", "ref"]).groupBy("caveat_key").agg(F.min("order").alias("order"))
    return hits.join(caveats, "caveat_key").orderBy("order", "caveat_key")


def series_facets(variable_id: str, theme: str | None, source_ids: list[str], unit_id: str | None = None) -> list[tuple[int, str, str]]:
    """(order, kind, ref) of what a series touches, the most specific first."""
    found = [("variable", variable_id), *(("source", s) for s in source_ids), ("theme", theme), ("unit", unit_id)]
    return [(i, k, r) for i, (k, r) in enumerate(x for x in found if x[1] is not None)]


def provenance(cells: DataFrame, sources: DataFrame, editions: DataFrame) -> DataFrame:
    """source_id, name, license, newest edition and rows of the sources that cells rest on."""
    used = cells.groupBy("source_id").agg(F.sum("n").alias("n"))
    newest = editions.groupBy("source_id").agg(F.max(F.struct("vintage", "edition_id")).alias("e"))
    return used.join(sources, "source_id", "left").join(newest, "source_id", "left").select("source_id", "name", "license", F.col("e.edition_id").alias("edition_id"), "n")


def edition(editions: DataFrame, source_id: str, vintage: str | None = None) -> str:
    """The one edition of a source; with several, the one of a vintage. None or many are an error."""
    rows = editions.filter(F.col("source_id") == source_id)
    rows = rows if vintage is None else rows.filter((F.col("vintage") == vintage) | (F.col("label") == vintage))
    found = [r["edition_id"] for r in rows.select("edition_id").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"{source_id} {vintage or ''}: {len(found)} editions {found}")
    return found[0]
