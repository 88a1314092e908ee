"""Derived tables that queries share, the cubes above all: built once for each state of their inputs and read from then on."""

from __future__ import annotations

import hashlib
import inspect
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: States of a stored table that stay: the one in use and the one before, which queries may still read.
KEPT = 2


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, local mode gets a temporary one; a cluster, whose machines don't share such folders, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shizuku-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Sees to it that checkpoint() has a folder: the shared one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def files_of(spark: SparkSession, path: str):
    """File system and Hadoop path of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state_of(inputs: list[DataFrame]) -> str:
    """A digest of the input files: names, lengths and times of change. A changed table has another."""
    seen = []
    for df in inputs:
        for name in df.inputFiles():
            fs, p = files_of(df.sparkSession, name)
            status = fs.getFileStatus(p)
            seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def definition(*modules) -> str:
    """A digest of the code that stored tables are made by: another one makes them anew."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()[:16]


def stored(name: str, inputs: list[DataFrame], build: Callable[[], DataFrame], partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), version: str = "") -> DataFrame:
    """The table that build() gives of the inputs: read if it was built from the same files by the same `version` before, else built beside its place and put there whole.

    Of the states of one set of input folders the KEPT latest stay.
    """
    spark, made = inputs[0].sparkSession, build()
    folders = sorted({f.rsplit("/", 1)[0] for df in inputs for f in df.inputFiles()})
    top = f"{scratch_dir(spark)}/shizuku-cubes/{name}-{hashlib.sha256(' '.join(folders).encode()).hexdigest()[:16]}"
    path = f"{top}/{state_of(inputs)}-{version}"
    fs, target = files_of(spark, path)
    if not fs.exists(target):
        stage = f"{path}__building_{uuid.uuid4().hex}"
        rows = made.sortWithinPartitions(*sort_by) if sort_by else made
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(stage)
        _, staged = files_of(spark, stage)
        if fs.exists(target):  # built by another at the same time
            fs.delete(staged, True)
        elif not fs.rename(staged, target):
            raise OSError(f"cannot move {stage} to {path}")
        states = sorted((s for s in fs.listStatus(target.getParent()) if "__building_" not in s.getPath().getName()), key=lambda s: -s.getModificationTime())
        for old in states[KEPT:]:
            fs.delete(old.getPath(), True)
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)
