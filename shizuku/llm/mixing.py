"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow with a target, a number of words. Its documents, in a fixed shuffled order and up to three rounds
of it, get virtual finish times: the words of the source up to and including the document, divided by the target. All
flows together, sorted by that time, are taken until the budget, the words of all documents, is spent.

Running sums go through two levels, so that no task holds a whole source: documents are dealt to hash buckets, about as
many as the root of the source's rows; the sums of the buckets are added up in order, then the rows within each. Only
DataFrame functions are used.

Defined cases: null text has size 0 and takes part with nothing taken; null sources are one source, the last; sources
without words have target 0; repeated rows take part each for itself; without any words nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shizuku.llm.common import WORD, saved, small

#: No source and no document is taken more often than this.
ROUNDS = 3


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weight: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """source, source_size, weight, target. sources: one row a source, with its words.

    The budget, the words of all sources, is shared by weight (1, 2, 3, repeating, in order of the source's code points,
    null last, unless given); a target stops at `rounds` times its source's size, and the excess is shared again by
    weight until none is above. That ends where every other source has one common multiple of its weight: sources go
    in order of the multiple at which they stop, and running sums tell where the common one lies.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double") if weight is None else weight
    rows = sources.withColumn("weight", weight)
    cap = F.lit(float(rounds)) * F.col("source_size")
    by_stop = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before, used = F.coalesce(F.sum(cap).over(by_stop), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0))
    # The multiple if all sources before this one stop and none from here on does; the first that doesn't reach its stop sets it.
    level = (F.sum("source_size").over(everything) - before) / (F.sum("weight").over(everything) - used)
    rows = rows.withColumn("__level", level).withColumn("__free", F.col("__level") <= cap / F.col("weight"))
    common = F.min(F.when(F.col("__free"), F.struct(cap / F.col("weight"), F.col("__level")))).over(everything)["__level"]
    return rows.withColumn("target", F.least(cap, F.coalesce(common * F.col("weight"), cap))).drop("__level", "__free")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken, first_finish (virtual time of the first copy)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    rows = saved(rows.withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))), "mix-sizes")
    known = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # null as a value that joins
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sources, rounds=rounds).withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
    plan = saved(plan.select(known.alias("flow"), "source_size", "target", "budget", F.ceil(F.sqrt("n")).cast("long").alias("buckets")), "mix-targets")

    # Level 1: sums of a source's buckets, in order of the buckets.
    dealt = rows.withColumn("flow", known).join(small(plan), "flow").withColumn("bucket", F.floor(F.col("buckets") * (F.conv(F.substring("shuffle", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)))))
    dealt = dealt.select("doc_id", "source", "size", "shuffle", "flow", "source_size", "target", "budget", "bucket")
    sums = dealt.groupBy("flow", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("flow").orderBy("bucket")) - F.col("words")).drop("words")
    # Level 2: the rows of a bucket.
    inner = Window.partitionBy("flow", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(sums, ["flow", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(inner)).drop("before", "bucket", "flow")

    # Every round is a copy with a finish time of its own; what finishes after all flows have met their target isn't queued.
    # Of a document that crosses the target, more than half must lie before it.
    copies = placed.withColumn("end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda k: F.col("upto") + k * F.col("source_size"))))
    copies = copies.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("finish", F.col("end") / F.col("target"))
    queued = copies.filter((F.col("end") - F.col("size") / 2) <= F.col("target"))
    taken = within_budget(queued)
    # A document's copies come together again by its place in its source, which is its own.
    key = ("source", "shuffle", "upto", "doc_id", "size")
    chosen = taken.groupBy(*(F.col(c).alias(f"own_{c}") for c in key)).agg(F.count("*").alias("copies"), F.min("finish").alias("first_finish"))
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in key]
    out = placed.join(chosen, same, "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), "first_finish")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


#: Slices of virtual time that the queue's running sum goes through.
SLICES = 4096


def within_budget(queued: DataFrame) -> DataFrame:
    """The copies whose turn, in order of finish, comes before the budget is spent."""
    rows = queued.withColumn("slice", F.least(F.floor(F.col("finish") * SLICES), F.lit(2 * SLICES)).cast("int"))
    sums = rows.groupBy("slice").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("ahead", F.sum("words").over(Window.orderBy("slice")) - F.col("words"))
    rows = rows.join(F.broadcast(sums), "slice")  # at most 2 * SLICES + 1 rows
    inside = rows.filter(F.col("ahead") + F.col("words") <= F.col("budget"))
    # Only the slice in which the budget ends needs its rows in order.
    inner = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = rows.filter((F.col("ahead") < F.col("budget")) & (F.col("ahead") + F.col("words") > F.col("budget")))
    across = across.withColumn("turn", F.col("ahead") + F.sum("size").over(inner) - F.col("size")).filter(F.col("turn") < F.col("budget")).drop("turn")
    return inside.unionByName(across).drop("slice", "words", "ahead")


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
