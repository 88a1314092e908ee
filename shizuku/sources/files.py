"""Readers and writers of open-data files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", **options) -> DataFrame:
    """CSV with a header in UTF-8 or another encoding ('windows-31j' for Japanese files of old)."""
    return spark.read.options(header=True, encoding=encoding, mode="FAILFAST", **options).schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_geojson(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """polygon_id, rings of the Polygon and MultiPolygon features of FeatureCollections."""
    feature = f"struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"  # noqa: F541
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"features array<{feature}>").alias("c"))
    f = raw.select(F.explode("c.features").alias("f")).select(F.col("f.properties")[id_property].alias("polygon_id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("xy"))
    single = F.from_json("xy", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("xy", "array<array<array<array<double>>>>"))
    return f.select("polygon_id", F.when(F.col("type") == "Polygon", single).when(F.col("type") == "MultiPolygon", multi).alias("rings")).filter("rings IS NOT NULL")


def to_geojson(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One Feature as JSON text a row."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """Cells of a worksheet as text; shared strings without their reading aids."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns):
                shared.append("".join(t.text or "" for t in [*item.findall("m:t", ns), *item.findall("m:r/m:t", ns)]))
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", ns):
            out: list[str | None] = []
            for cell in row.findall("m:c", ns):
                at = _column(cell.get("r"))
                out += [None] * (at + 1 - len(out))
                v = cell.find("m:v", ns)
                text = v.text if v is not None else "".join(t.text or "" for t in cell.iterfind(".//m:t", ns)) or None
                out[at] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            yield out


def serial_date(serial: float) -> str:
    """The ISO day of a spreadsheet's day number."""
    return (date(1899, 12, 30) + timedelta(days=int(serial))).isoformat()


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """path, row, cells array<string> of workbooks; a file is read in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = list(sheet_rows(data, sheet))
                yield pd.DataFrame({"path": [name] * len(rows), "row": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with quotes doubled; with a byte order mark for spreadsheets."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# Terms of the Darwin Core standard, by file of the archive.
DWC = {
    "event": ["eventID", "eventDate", "locationID", "samplingProtocol"],
    "occurrence": ["occurrenceID", "eventID", "basisOfRecord", "scientificName", "occurrenceStatus", "license"],
    "measurement": ["measurementID", "eventID", "measurementType", "measurementValue", "measurementUnit"],
}


def darwin_core(records: DataFrame, licenses: list[str]) -> dict[str, DataFrame]:
    """Tables of a Darwin Core Archive of the records under one of the licenses; an event keeps its first row by record."""
    open_rows = records.filter(F.col("license").isin(*licenses))
    clean = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ")).alias(c)
    first = open_rows.groupBy("eventID").agg(F.min(F.struct("occurrenceID", "eventDate", "locationID", "samplingProtocol")).alias("e"))
    events = first.select("eventID", "e.eventDate", "e.locationID", "e.samplingProtocol")
    out = {"event": events.select(*map(clean, DWC["event"])), "occurrence": open_rows.select(*map(clean, DWC["occurrence"]))}
    if "measurementValue" in records.columns:
        out["measurement"] = open_rows.filter("measurementValue IS NOT NULL").select(*map(clean, DWC["measurement"]))
    return out


def meta_xml(tables: dict[str, DataFrame], files: dict[str, list[str]] | None = None) -> str:
    """The archive's descriptor: events are its core, all else hangs on them. files: the files of each table, `<table>.txt` by default."""
    parts = []
    for name, df in tables.items():
        tag = "core" if name == "event" else "extension"
        fields = "".join(f'<field index="{i}" term="http://rs.tdwg.org/dwc/terms/{c}"/>' for i, c in enumerate(df.columns))
        key = df.columns.index("eventID")
        places = "".join(f"<location>{x}</location>" for x in (files or {}).get(name, [f"{name}.txt"]))
        parts.append(f'<{tag} encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" ignoreHeaderLines="1"><files>{places}</files><{"id" if tag == "core" else "coreid"} index="{key}"/>{fields}</{tag}>')
    return '<archive xmlns="http://rs.tdwg.org/dwc/text/">' + "".join(parts) + "</archive>"


def write_darwin_core(tables: dict[str, DataFrame], path: str) -> None:
    """The archive as a folder: tab-separated files of each table, in a folder of its own, and meta.xml, which names every one of them."""
    from shizuku.sources.stored import files_of

    files = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").csv(f"{path}/{name}")
        fs, folder = files_of(df.sparkSession, f"{path}/{name}")
        found = (str(x.getPath().getName()) for x in fs.listStatus(folder))
        files[name] = sorted(f"{name}/{x}" for x in found if x.startswith("part-"))
        fs, target = files_of(df.sparkSession, f"{path}/meta.xml")
    stream = fs.create(target, True)
    stream.write(bytearray(meta_xml(tables, files).encode()))
    stream.close()


def read_darwin_core(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an archive as meta.xml describes them: rows that hang on an event which isn't there are an error of the archive, see `orphans`."""
    text = spark.read.option("wholetext", True).text(f"{path}/meta.xml").first()[0]
    ns = {"d": "http://rs.tdwg.org/dwc/text/"}
    out = {}
    for part in ElementTree.fromstring(text):
        places = [x.text for x in part.findall("d:files/d:location", ns)]
        columns = [x.get("term").rsplit("/", 1)[-1] for x in part.findall("d:field", ns)]
        name = places[0].split("/")[0].removesuffix(".txt")
        out[name] = spark.read.option("header", True).option("sep", "\t").option("quote", "").schema(", ".join(f"{c} string" for c in columns)).csv([f"{path}/{x}" for x in places])
    return out


def orphans(archive: dict[str, DataFrame]) -> DataFrame:
    """table, eventID of rows whose event the archive doesn't have."""
    found = [df.select(F.lit(name).alias("table"), "eventID").join(archive["event"].select("eventID"), "eventID", "left_anti").select("table", "eventID") for name, df in archive.items() if name != "event"]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
