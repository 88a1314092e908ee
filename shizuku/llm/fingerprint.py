"""Fingerprints of documents by a homomorphic multiset hash.

A document is the multiset of its paragraphs, the stretches of text between line ends, where a paragraph of several
sentences is divided after each, so that an edit within a long one leaves the rest of it alike. Every paragraph is hashed to a wide
vector of LANES numbers, each -1 or 1; the document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo
2 to the 20th, with the number of paragraphs in front. Sums don't depend on order, and inserting or deleting a paragraph
adds or takes off its vector (`combined`). Equal texts have equal fingerprints; and because lanes of different
paragraphs are independent signs, the angle between two sums estimates how much of the paragraphs two documents share
(`likeness`), with a standard error of about one through the root of LANES.

A long that holds LANES_EACH lanes of 21 bits is added at once: the top bit of each lane takes the carry and is cut off.
Only DataFrame functions are used.

Defined cases: a null text counts as empty and is one empty paragraph; repeated rows have equal fingerprints; for the
edited texts, documents follow one another by id, then by text; a table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shizuku.llm.common import bound, saved, small

#: Lanes in one long, bits of a lane (and one for the carry), hashes of a paragraph, longs of a fingerprint.
LANES_EACH, BITS, HASHES, LONGS = 3, 20, 3, 63
LANES = LANES_EACH * LONGS
_ONES = sum(1 << (BITS + 1) * i for i in range(LANES_EACH))
_LANE = (1 << BITS) - 1
_KEEP = _ONES * _LANE
#: Rows that a bucket of neighbouring documents has, about, and the stretches of ids, of like numbers of rows, that buckets are parts of.
NEAR, STRETCHES = 2048, 128


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n|(?<=[.!?]) ")


def _bits(paragraph: Column) -> Column:
    """HASHES 64-bit hashes; bits k, k + 21 and k + 42 of a hash make the signs of the three lanes of long k."""
    return F.transform(F.array(*(F.xxhash64(F.lit(i), paragraph) for i in range(HASHES))), lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))


def lanes(text: Column) -> Column:
    """The fingerprint as an array: paragraphs, then LONGS longs with how often each lane's sign was 1, modulo 2**BITS."""
    ones, keep = F.lit(_ONES), F.lit(_KEEP)
    per = LONGS // HASHES
    place = F.array(*(F.struct(F.lit(i).alias("h"), F.lit(k).alias("k")) for i in range(HASHES) for k in range(per)))

    def summed(hashes: Column) -> Column:
        # For each long: its three bits of every paragraph, added up.
        one = lambda p: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + F.call_function("shiftright", F.get(h, p["h"]), p["k"]).bitwiseAND(ones)).bitwiseAND(keep))
        return F.concat(F.array(F.size(hashes).cast("long")), F.transform(place, one))

    return bound(F.transform(paragraphs(F.coalesce(text, F.lit(""))), _bits), summed)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's added (sign 1) or taken off (-1)."""
    full = F.lit(_ONES << BITS)
    add = lambda x, y: (x + y).bitwiseAND(F.lit(_KEEP)) if sign > 0 else (x.bitwiseOR(full) - y).bitwiseAND(F.lit(_KEEP))
    head = F.array(F.get(a, F.lit(0)) + sign * F.get(b, F.lit(0)))
    return F.concat(head, F.zip_with(F.slice(a, 2, LONGS), F.slice(b, 2, LONGS), add))


def signed(fp: Column) -> Column:
    """The lanes as sums of signs: twice the ones less the paragraphs, in the range that wraps around at 2**BITS."""
    half = 1 << BITS - 1
    lane = lambda x, i: F.shiftright(x, (BITS + 1) * i).bitwiseAND(F.lit(_LANE))
    unpack = F.flatten(F.transform(F.slice(fp, 2, LONGS), lambda x: F.array(*(lane(x, i) for i in range(LANES_EACH)))))
    return F.transform(unpack, lambda x: (F.pmod(2 * x - F.get(fp, F.lit(0)) + half, F.lit(2 * half)) - half).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two fingerprints' signed lanes, at least 0; 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    def cosine(x: Column) -> Column:
        norm = F.sqrt(dot(x["a"], x["a"]) * dot(x["b"], x["b"]))
        return F.when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x["a"], x["b"]) / norm)))

    return F.when(a == b, 1.0).otherwise(bound(F.struct(signed(a).alias("a"), signed(b).alias("b")), cosine))


def text_of(fp: Column) -> Column:
    """A fingerprint as a string of fixed length."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """docs with `next`, a struct of `columns` of the next row by id (after the last: the first). Ids are numbers, or texts in the order of their UTF-8 bytes.

    Spark deals the ids alone, without the rows, to STRETCHES ranges of like numbers of them. Rows go to buckets, equal parts of
    a stretch as many as its rows call for: by the id's number, or by the bytes of a text behind what the stretch's first and last id have
    in common, so that ids far from all others, dense ones or long common beginnings don't put the rest into one bucket. A
    bucket needs one row from outside, the first of the next bucket that has any; those rows are sent to both. So no task sorts more
    than a bucket, and nothing but the stretches' ends goes to the driver.
    """
    number = isinstance(docs.schema[id_col].dataType, T.NumericType)
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i") if number else F.col(id_col).cast("string").alias("i"))
    ranges = ids.repartitionByRange(STRETCHES, "i").groupBy(F.spark_partition_id().alias("p")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n"))
    found = sorted(ranges.collect(), key=lambda r: r["lo"] if number else r["lo"].encode())  # as many rows as stretches
    common = [0 if number else len(os.path.commonprefix([r["lo"].encode(), r["hi"].encode()])) for r in found]
    of_bytes = lambda b, skip: float(int.from_bytes(b[skip : skip + 7].ljust(7, b"\0"), "big"))
    ends = [(float(r["lo"]), float(r["hi"])) if number else (of_bytes(r["lo"].encode(), k), of_bytes(r["hi"].encode(), k)) for r, k in zip(found, common, strict=True)]
    parts = [max(1, r["n"] // NEAR) for r in found]
    listed = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    at = lambda xs, s, kind="double": F.get(listed(xs, kind), s)
    key = F.col(id_col) if number else F.col(id_col).cast("string")
    kind = docs.schema[id_col].dataType.simpleString() if number else "string"
    stretch = F.size(F.filter(listed([r["lo"] for r in found[1:]], kind), lambda x: x <= key))

    def bucket_in(s: Column) -> Column:
        # A number that sorts like the id within its stretch.
        value = key.cast("double") if number else F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), at(common, s, "int") + 1, F.lit(7))), 14, "0"), 16, 10).cast("double")
        wide = [max(hi - lo, 1e-300) / n for (lo, hi), n in zip(ends, parts, strict=True)]
        first = [sum(parts[:k]) for k in range(len(parts))]
        part = F.least(at(parts, s, "long") - 1, F.floor((value - at([lo for lo, _ in ends], s)) / at(wide, s)))
        return F.struct(s.cast("long").alias("s"), (at(first, s, "long") + F.greatest(F.lit(0), part)).alias("b"))

    none = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("b"))  # null ids come first
    bucket = F.when(F.col(id_col).isNull(), none).otherwise(bound(stretch, bucket_in)) if found else none
    rows = docs.withColumn("__b", bucket["b"])
    firsts = docs.select(F.col(id_col), bucket.alias("k")).groupBy("k.s", "k.b").agg(F.min(id_col).alias("__first"))
    firsts = saved(firsts.select("s", F.col("b").alias("__b"), "__first"), "bucket-starts")
    # The bucket before: within the stretch, or the last one of the stretch before, which is never empty; before the first comes the last of all.
    lasts = {r["s"]: r["b"] for r in firsts.groupBy("s").agg(F.max("__b").alias("b")).collect()}
    order = sorted(lasts)
    before = F.create_map(*(F.lit(x).cast("long") for k, s in enumerate(order) for x in (s, lasts[order[k - 1]]))) if order else F.lit(None).cast("map<bigint,bigint>")
    lag = F.lag("__b").over(Window.partitionBy("s").orderBy("__b"))
    firsts = saved(firsts.select("__b", F.coalesce(lag, F.try_element_at(before, F.col("s"))).alias("__to"), "__first"), "bucket-firsts")
    rows = rows.join(small(firsts), "__b")
    # Each row goes to its own bucket; the first rows go to the one before as well, behind all others.
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("late"))
    both = F.array(own, F.struct(F.col("__to").alias("b"), F.lit(1).alias("late")))
    dealt = rows.withColumn("__at", F.explode(F.when(F.col(id_col).eqNullSafe(F.col("__first")), both).otherwise(F.array(own)))).drop("__b", "__to", "__first")
    order = Window.partitionBy("__at.b").orderBy("__at.late", F.col(id_col).asc_nulls_first(), *columns[:1])
    nxt = F.lead(F.struct(*columns)).over(order)
    return dealt.withColumn("next", nxt).filter("__at.late = 0").drop("__at")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fp and, of the text edited with the next document, edited_sha256, edited_fp; next_fp."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", lanes(F.col("text")))
    near = with_next(rows, "doc_id", ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = near.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), text.alias("edited"))
    return out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_fp", lanes(F.col("edited"))).drop("edited")
