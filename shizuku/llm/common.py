"""Helpers shared by the training-data operators: scratch tables, size-checked broadcasts, columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows a side may have to be broadcast: at 64 bytes a row, 16 MB.
BROADCAST_ROWS = 250_000
#: Names of helper columns start with this, so that they don't clash with a caller's own.
OWN = "__sz_"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, local mode gets a temporary one; a cluster, whose machines don't share such folders, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shizuku-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet into the shared scratch folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/shizuku/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more: what was made of them is saved itself."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast df, a saved table, if it has at most `most` rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Gives memory that a task has freed back to the system. Python workers live on between tasks and stages, and what
    their allocators keep counts against the executor. Called at the end of functions that held caches or large batches."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once although use names it often, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text: the fold that the contracts deal documents by."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
