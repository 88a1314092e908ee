"""Tables in parts: folders of Parquet files that one manifest lists, so that changed parts are replaced and all others stay as they are.

A part is the rows of one value of the part column, a year say. Its mark, rows and a hash of what it was made from, says whether it
has changed. New parts are written beside the old ones; the manifest, replaced in one step when all of them are there, makes them the
table. A write that fails leaves the old table whole. Folders that a change retires are deleted by the change after it, so readers that
began before can finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shizuku.sources.stored import files_of
from shizuku.sources.tables import read_text, write_text

#: The folders' column; the part column itself stays in the files.
_FOLDER = "__part"
NONE = "__none__"


def marks_of(rows: DataFrame, part: Column) -> dict[str, str]:
    """The mark of each part of the rows: how many there are, and sums of two hashes of them, which don't depend on their order. One pass; the rows aren't shuffled, only sums are."""
    columns = sorted(rows.columns)
    sums = rows.groupBy(F.coalesce(part.cast("string"), F.lit(NONE)).alias("p")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"), F.sum(F.hash(*columns).cast("long")).alias("t"))
    return {r["p"]: f"{r['n']} {r['s']} {r['t']}" for r in sums.collect()}  # one row a part


@dataclass
class Parted:
    """A table in parts at a path."""

    spark: SparkSession
    path: str
    _known: dict | None = field(default=None, repr=False)

    def manifest(self) -> dict:
        """schema, state (free text of the one who wrote it) and parts: folder, mark and rows by value."""
        if self._known is None:
            text = read_text(self.spark, f"{self.path}/manifest.json")
            self._known = json.loads(text) if text else {"schema": None, "state": None, "parts": {}}
        return self._known

    def read(self, wanted: Callable[[str], bool] | None = None) -> DataFrame:
        """All rows, or those of the parts that are wanted; no other folder is listed or opened."""
        known = self.manifest()
        if known["schema"] is None:
            raise ValueError(f"{self.path} has no table")
        folders = [f"{self.path}/{p['folder']}" for value, p in known["parts"].items() if p["rows"] and (wanted is None or wanted(value))]
        return self.spark.read.schema(known["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], known["schema"])

    def rows(self) -> int:
        return sum(p["rows"] for p in self.manifest()["parts"].values())

    def changed(self, marks: dict[str, str], state: str | None = None) -> list[str]:
        """Parts that aren't there with this mark. A table of another state is changed in all parts."""
        known = self.manifest()
        same = known["parts"] if known["state"] == state else {}
        return sorted(v for v, mark in marks.items() if same.get(v, {}).get("mark") != mark)

    def replace(self, make: Callable[[list[str]], DataFrame], part: str, marks: dict[str, str], state: str | None = None, sort_by: Iterable[str] = (), also: dict | None = None) -> list[str]:
        """Writes the parts that have changed, as make(values) gives their rows, drops those that aren't in `marks`, and returns what was written. also: kept in the manifest."""
        known, todo = self.manifest(), self.changed(marks, state)
        kept = {v: p for v, p in known["parts"].items() if v in marks and v not in todo}
        schema, version = known["schema"], f"v-{uuid.uuid4().hex}"
        if todo or schema is None:
            made = make(todo).withColumn(_FOLDER, F.coalesce(F.col(part).cast("string"), F.lit(NONE)))
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.drop(_FOLDER).schema)
            (made.sortWithinPartitions(_FOLDER, *sort_by) if sort_by else made).write.partitionBy(_FOLDER).parquet(f"{self.path}/{version}")
            written = self.spark.read.schema(f"{schema}, {_FOLDER} string").parquet(f"{self.path}/{version}")
            counts = {r[_FOLDER]: r["n"] for r in written.groupBy(_FOLDER).agg(F.count("*").alias("n")).collect()} if todo else {}
            if strange := set(counts) - set(todo):
                raise ValueError(f"rows of parts that weren't asked for: {sorted(strange)[:5]}")
            name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            kept |= {v: {"folder": f"{version}/{_FOLDER}={name(v)}", "mark": marks[v], "rows": counts.get(v, 0)} for v in todo}
        new = {"schema": schema, "state": state, "parts": kept, **(also or {})}
        self._commit(new)
        return todo

    def _commit(self, new: dict) -> None:
        before = self.manifest()
        folders = lambda m: {p["folder"] for p in m["parts"].values()}
        new["retired"] = sorted(folders(before) - folders(new))
        jvm, beside = self.spark._jvm, f"{self.path}/manifest-{uuid.uuid4().hex}"
        write_text(self.spark, beside, json.dumps(new, ensure_ascii=False))
        _, source = files_of(self.spark, beside)
        fs, target = files_of(self.spark, f"{self.path}/manifest.json")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, how)
        self._known = new
        for folder in before.get("retired", []):
            fs.delete(files_of(self.spark, f"{self.path}/{folder}")[1], True)
