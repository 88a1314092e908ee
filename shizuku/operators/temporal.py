"""Joins by time: what was valid at a moment, and the last thing that happened before it, also where few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each size of a block of time is so many of the one before; sizes there are: with days, 16**5 of them are 2,870 years.
STEP, SIZES = 16, 6
#: Slices of time that keys are divided into.
SLICES = 128


def blocks(start: Column, end: Column) -> Column:
    """Array of (size, block) that together are the whole numbers of [start, end): blocks of the largest sizes that fit between smaller ones at both ends.

    Block b of size k is [b * STEP**k, (b + 1) * STEP**k). Each number of the range lies in one block, so a point meets the range once. At
    the ends there are fewer than 2 * STEP blocks of a size, however long the range.
    """
    span = lambda k: (F.ceil(start / STEP**k).cast("long"), F.floor(end / STEP**k).cast("long"))
    listed = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    named = lambda k: lambda b: F.struct(F.lit(k).alias("size"), b.alias("block"))
    parts = []
    for k in range(SIZES):
        lo, hi = span(k)
        up, down = span(k + 1) if k + 1 < SIZES else (hi, hi)
        own = F.when(up < down, F.concat(listed(lo, up * STEP), listed(down * STEP, hi))).otherwise(listed(lo, hi))
        # Where the next size has no block in the range, this one takes all; the sizes above have none either.
        parts.append(F.transform(own, named(k)))
    return F.concat(*parts)


def valid_at(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """points joined with the ranges [start, end) of equal keys that hold `at`, all three whole numbers, of days, say. Without `start` a range has held always, without `end` it still does.

    Ranges are split into blocks, points listed once for every size of block, and both meet in an equi-join on key and block, which Spark
    can divide where a key has most rows; no range is compared with points outside of it. Points without `at` and empty ranges meet nothing, null
    keys neither. Columns other than the keys keep their names, so they must differ.
    """
    bounds = points.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()  # one row
    lo, hi = F.lit(bounds["lo"] or 0), F.lit((bounds["hi"] or 0) + 1)
    # Beyond the points a range needs no blocks.
    held = blocks(F.greatest(F.coalesce(F.col(start), lo), lo).cast("long"), F.least(F.coalesce(F.col(end), hi), hi).cast("long"))
    split = ranges.withColumn("__b", F.explode(held)).withColumns({"__size": F.col("__b.size"), "__block": F.col("__b.block")}).drop("__b")
    sizes = F.array(*(F.struct(F.lit(k).alias("size"), F.floor(F.col(at) / STEP**k).cast("long").alias("block")) for k in range(SIZES)))
    listed = points.filter(F.col(at).isNotNull()).withColumn("__b", F.explode(sizes)).withColumns({"__size": F.col("__b.size"), "__block": F.col("__b.block")}).drop("__b")
    return listed.join(split, [*keys, "__size", "__block"]).drop("__size", "__block")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, slices: int = SLICES) -> DataFrame:
    """left with `found`, a struct of right's row of equal keys with the latest `since` up to `at`; null if there is none.

    Of right rows of one key and time the greatest counts, by their columns in order. Time is cut into slices of like numbers of rows, whose ends are
    the only thing that goes to the driver. Within a key and slice a window carries the last right row on; what earlier slices had last is
    one pre-aggregated row for each key and slice. So no task holds more of a key than a slice, and a key's rows are never sorted
    as a whole. Null keys and null times meet nothing; such left rows stay, without a match.
    """
    kind = left.schema[at].dataType.simpleString()
    rows = right.select(*keys, F.col(since).cast(kind).alias("__t"), F.struct(*(F.col(c) for c in right.columns)).alias("__v")).filter(F.col("__t").isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    whole = F.lit(True)
    for c in (*keys, at):
        whole = whole & F.col(c).isNotNull()
    times = left.filter(whole).select(F.col(at).alias("__t")).unionByName(rows.select("__t"))
    ends = times.repartitionByRange(slices, "__t").groupBy(F.spark_partition_id().alias("p")).agg(F.min("__t").alias("t")).select("t").collect()  # a row a slice
    inner = sorted(r["t"] for r in ends)[1:]
    cut = F.size(F.filter(F.array(*map(F.lit, inner)).cast(f"array<{kind}>"), lambda x: x <= F.col("__t"))) if inner else F.lit(0)

    names = left.columns
    mine = left.filter(whole).select(*keys, F.col(at).alias("__t"), F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"), F.struct(*(F.col(c) for c in names)).alias("__l"))
    both = mine.unionByName(rows, allowMissingColumns=True).withColumn("__s", cut)
    order = Window.partitionBy(*keys, "__s").orderBy("__t", F.col("__l").isNotNull(), "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("__near", F.last("__v", ignorenulls=True).over(order)).filter("__l IS NOT NULL").select(*keys, "__s", "__l", "__near")
    # What each key had last before each of its slices.
    lasts = both.groupBy(*keys, "__s").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct("__t", "__v"))).alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "__s", F.max("__m").over(before)["__v"].alias("__far")).filter("__far IS NOT NULL")
    out = near.join(carried, [*keys, "__s"], "left").select("__l.*", F.coalesce("__near", "__far").alias("found"))
    alone = left.filter(~whole).withColumn("found", F.lit(None).cast(rows.schema["__v"].dataType))
    return out.unionByName(alone)


def editions(rows: DataFrame, keys: list[str], since: str) -> DataFrame:
    """rows with `until`, the `since` of the next edition of equal keys: validity ranges of editions that each hold until the next. Editions of one time: the greatest row's holds."""
    others = [c for c in rows.columns if c not in keys and c != since]
    one = rows.groupBy(*keys, since).agg(F.max(F.struct(*others)).alias("__v")) if others else rows.select(*keys, since).distinct().withColumn("__v", F.struct())
    nxt = F.lead(since).over(Window.partitionBy(*keys).orderBy(since))
    return one.withColumn("until", nxt).select(*keys, since, "until", *(F.col(f"__v.{c}").alias(c) for c in others))
