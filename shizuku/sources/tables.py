"""Publishing tables: staged replacement, partitioned Parquet with a manifest, fingerprints and lineage."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = _fs(spark, path)
    stream = fs.create(place, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file's content, without a job; None if there is none."""
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fingerprint(df: DataFrame) -> dict:
    """Rows and a hash of them that doesn't depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.sum(F.hash(*df.columns).cast("long")).alias("t")).first()
    text = json.dumps([df.schema.simpleString(), row["n"], str(row["s"]), str(row["t"])])
    return {"rows": row["n"], "hash": hashlib.sha256(text.encode()).hexdigest()}


def publish(df: DataFrame, path: str, checks: Iterable[Callable[[DataFrame], None]] = (), partition_by: list[str] = (), sort_by: list[str] = ()) -> dict:
    """Writes df beside `path`, runs the checks on what was written, then puts it in the old table's place. A failed check leaves the old table."""
    spark = df.sparkSession
    stage, old = f"{path}__building_{uuid.uuid4().hex}", f"{path}__old_{uuid.uuid4().hex}"
    rows = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = rows.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(stage)
    fs, staged = _fs(spark, stage)
    try:
        written = spark.read.parquet(stage)
        for check in checks:
            check(written)
        found = fingerprint(written)
    except Exception:
        fs.delete(staged, True)
        raise
    _, target = _fs(spark, path)
    _, aside = _fs(spark, old)
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        fs.delete(staged, True)
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(staged, target):
        if had:
            fs.rename(aside, target)  # the old table comes back; what was written stays beside it
        raise OSError(f"cannot move {stage} to {path}")
    if had:
        fs.delete(aside, True)
    return found


def export(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None, licenses: dict[str, str] | None = None) -> dict:
    """Parquet folders and datapackage.json: tables whose fingerprint is unchanged aren't written again, those no longer named are removed."""
    spark = next(iter(tables.values())).sparkSession
    fs, manifest = _fs(spark, f"{path}/datapackage.json")
    before = {}
    if fs.exists(manifest):
        text = spark.read.text(f"{path}/datapackage.json", wholetext=True).first()[0]
        before = {r["name"]: r for r in json.loads(text)["resources"]}
    out = []
    for name, df in tables.items():
        print_of = fingerprint(df)
        entry = {"name": name, "path": name, "format": "parquet", "rows": print_of["rows"], "hash": print_of["hash"], "partition_by": (partition_by or {}).get(name, []), "license": (licenses or {}).get(name), "schema": {"fields": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]}}
        if before.get(name, {}).get("hash") != entry["hash"]:
            publish(df, f"{path}/{name}", partition_by=entry["partition_by"])
        out.append(entry)
    for gone in set(before) - set(tables):
        fs.delete(_fs(spark, f"{path}/{gone}")[1], True)
    package = {"profile": "data-package", "resources": out}
    write_text(spark, f"{path}/datapackage.json", json.dumps(package, ensure_ascii=False, indent=1))
    return package


def leaves(df: DataFrame) -> list[tuple[str, str]]:
    """(kind, where) of everything that a plan reads, subqueries included: 'files' and a path, 'memory' for rows that came with the plan or from a checkpoint, or the name of the relation's class."""
    plan, out = df._jdf.queryExecution().analyzed(), []
    below = plan.subqueriesAll()
    for p in [plan, *(below.apply(i) for i in range(below.size()))]:
        found = p.collectLeaves()
        for leaf in (found.apply(i) for i in range(found.size())):
            kind = leaf.getClass().getSimpleName()
            if kind in ("LocalRelation", "Range", "OneRowRelation", "LogicalRDD"):
                out.append(("memory", kind))
            elif kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                paths = leaf.relation().location().rootPaths()
                out += [("files", paths.apply(i).toString()) for i in range(paths.size())]
            else:
                out.append((kind, leaf.simpleStringWithNodeId() if hasattr(leaf, "simpleStringWithNodeId") else kind))
    return sorted(set(out))


@dataclass
class Catalog:
    """Named tables under a folder that knows what each stage has read, by the stage's plan, and refuses what no stage has verified or what is read past it."""

    spark: SparkSession
    path: str
    verified: dict[str, dict] = field(default_factory=dict)
    reads: list[str] = field(default_factory=list)
    lineage: dict[str, dict] = field(default_factory=dict)

    def read(self, name: str) -> DataFrame:
        if name not in self.verified:
            raise ValueError(f"{name} hasn't been verified")
        self.reads.append(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, name: str, stage: Callable[[Catalog], DataFrame], checks: Iterable[Callable[[DataFrame], None]] = (), **how) -> dict:
        """Publishes what a stage gives. Files of other tables than those it has read here, or sources that aren't files, are refused."""
        self.reads = []
        rows = stage(self)
        place = lambda n: (lambda fs, p: fs.makeQualified(p).toString())(*_fs(self.spark, f"{self.path}/{n}"))
        known = {place(n): n for n in dict.fromkeys(self.reads)}
        read = [(kind, where) for kind, where in leaves(rows) if kind != "memory"]
        if past := [where for kind, where in read if kind != "files" or where not in known]:
            raise ValueError(f"{name} reads past the catalog: {past}")
        found = publish(rows, f"{self.path}/{name}", checks, **how)
        self.lineage[name] = {"from": {known[where]: self.verified[known[where]]["hash"] for _, where in read}, **found}
        self.verified[name] = found
        return found
