"""Benchmark decontamination: windows of benchmark words that occur in documents, and texts without them.

Texts are lower-cased (A-Z) and cut into words of letters, digits and everything beyond ASCII. A benchmark item's windows are its
runs of `width` words; an item of fewer words, but at least one, is one window. The hashes of the distinct windows are broadcast,
where their number is small (`common.small`; else the same join shuffles), and every window of every document is looked up in
them. What is met becomes a candidate, a position and the window's words, folded by the hash of the text, so copies of a text
are one row. In a second pass over the documents the candidates of a text's hash are verified against its words; those
verified give hit words, spans and items. Only DataFrame functions are used.

Items of a window travel as sets: windows that occur in the same items carry the same set, and a text's row holds each set that it
meets once.

Defined cases: null and empty texts have no words and are never hit; items with null or wordless text are no items; windows of
items whose id is null hit words, but aren't listed; equal windows of several items count for each of them; rows with equal ids or texts
are judged each for itself, with equal results for equal texts; empty tables give no rows, or documents without hits. Columns
of the input named like the result's own give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shizuku.llm.common import bound, saved, small

#: Words of a window, and hashes of texts that are broadcast at most: 24 bytes each, 48 MB.
WIDTH, HASHES = 10, 2_000_000
#: What stands between words of a lower-cased text, and pieces of a text as it is: words and what stands between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECES = r"([0-9A-Za-z[^\x00-\x7F]]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
IS_WORD = r"^[0-9A-Za-z[^\x00-\x7F]]"
RESULT = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """text with A-Z in lower case. Spark's quick `lower` does that where all is ASCII; elsewhere it would change other letters too."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _A, _Z))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(ws: Column, length: int) -> Column:
    """(pos, h) of all runs of `length` words: place of the first word, from 0, and the hash of the words."""
    last = F.size(ws) - length
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(ws, i + 1, length)).alias("h")))


def benchmark_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """gram (words), len, h and items (sorted ids as strings) of the distinct windows of all items."""
    ws = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    many = F.transform(F.sequence(F.lit(0), F.size("ws") - width), lambda i: F.slice("ws", i + 1, width))
    grams = ws.select("item", F.explode(F.when(F.size("ws") <= width, F.array("ws")).otherwise(many)).alias("gram"))
    # Hits need no order of items but that by strings; a null id adds none.
    by = grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return by.select("gram", F.size("gram").alias("len"), F.xxhash64("gram").alias("h"), "items")


def candidates(docs: DataFrame, grams: DataFrame, text_col: str) -> DataFrame:
    """th (hash of a text) and what its windows meet: `hits`, array of (pos, gram, s), and `sets`, array of (s, items)."""
    lengths = [r["len"] for r in grams.select("len").distinct().collect()]  # at most `width` numbers
    if not lengths:
        return docs.sparkSession.createDataFrame([], "th long, hits array<struct<pos:int,gram:array<string>,s:long>>, sets array<struct<s:long,items:array<string>>>")
    found = bound(words(F.col(text_col)), lambda ws: F.concat(*(F.coalesce(windows(ws, n), F.array().cast("array<struct<pos:int,h:bigint>>")) for n in sorted(lengths))))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("th"), F.explode(found).alias("w")).select("th", "w.pos", "w.h")
    met = rows.join(small(saved(grams.select("h").distinct(), "window-hashes")), "h", "left_semi").distinct()
    s = F.xxhash64("items")
    full = met.join(small(grams), "h").select("th", F.struct("pos", "gram", s.alias("s")).alias("hit"), F.struct(s.alias("s"), "items").alias("set"))
    return full.groupBy("th").agg(F.collect_set("hit").alias("hits"), F.collect_set("set").alias("sets"))


def spans_of(hits: Column) -> Column:
    """Maximal runs (first, last) of words inside of hits, sorted."""
    ends = F.array_sort(F.transform(hits, lambda x: F.struct(x["pos"].alias("first"), (x["pos"] + F.size(x["gram"]) - 1).alias("last"))))
    # A hit begins a run if nothing before it, in order of beginnings, reaches the word before it.
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        apart = acc["last"].isNotNull() & (x["first"] > acc["last"] + 1)
        done = F.when(apart, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(acc["done"])
        first = F.when(apart | acc["first"].isNull(), x["first"]).otherwise(acc["first"])
        return F.struct(done.alias("done"), first.alias("first"), F.when(apart | acc["last"].isNull(), x["last"]).otherwise(F.greatest(acc["last"], x["last"])).alias("last"))

    close = lambda acc: F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))))
    return F.aggregate(ends, start, step, close)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside of occurring windows), n_items, items (their ids as sorted strings), spans (first, last word of each run of hit words), contaminated."""
    grams = saved(benchmark_windows(benchmark, width, item_id, item_text), "windows")
    met = saved(candidates(docs, grams, text_col), "window-hits").select(F.col("th").alias("__th"), F.col("hits").alias("__hits"), F.col("sets").alias("__sets"))
    kept = [c for c in docs.columns if c not in RESULT or c == text_col]
    # Only texts that met a window go through the join with what they met, which has wide rows; their hashes alone tell them apart.
    named = docs.select(*kept, F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__h"))
    hashes, same = small(met.select("__th"), HASHES), F.col("__h") == F.col("__th")
    rows = named.join(hashes, same, "left_semi").join(met, same).unionByName(named.join(hashes, same, "left_anti"), allowMissingColumns=True)

    def judged(ws: Column) -> Column:
        true = F.filter("__hits", lambda x: F.slice(ws, x["pos"] + 1, F.size(x["gram"])) == x["gram"])
        ids = lambda own: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("__sets", lambda x: F.array_contains(own, x["s"])), lambda x: x["items"]))))
        full = bound(true, lambda x: F.struct(spans_of(x).alias("spans"), bound(F.array_distinct(F.transform(x, lambda y: y["s"])), ids).alias("items")))
        none = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.when(F.col("__hits").isNull(), none).otherwise(full).alias("d"))

    out = rows.withColumn("__r", bound(words(F.col("__text")), judged))
    hit = F.aggregate("__r.d.spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    named = out.select(*kept, F.col("__r.n_words").alias("n_words"), hit.alias("n_hit"), F.size("__r.d.items").cast("long").alias("n_items"), F.col("__r.d.items").alias("items"), F.col("__r.d.spans").alias("spans"))
    return named.withColumn("contaminated", F.col("n_hit") > 0)


def without(text: Column, spans: Column) -> Column:
    """text without the words of `spans` and what stands between them. What stands before and after a span stays."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(1))

    def rest(all_pieces: Column) -> Column:
        # A text's pieces are words and gaps in turn: word i is piece 2 i, or 2 i + 1 where a gap comes first.
        lead = F.when(F.get(all_pieces, F.lit(0)).rlike(IS_WORD), 0).otherwise(1)
        start = lambda j: F.when(j > 0, 2 * F.get(spans, j - 1)["last"] + lead + 1).otherwise(0)
        stop = lambda j: F.coalesce(2 * F.get(spans, j)["first"] + lead, F.size(all_pieces))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda j: F.slice(all_pieces, start(j) + 1, F.greatest(F.lit(0), stop(j) - start(j))))), "")

    return F.when(F.size(spans) > 0, bound(pieces, rest)).otherwise(text)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", least_items: int = 1, width: int = WIDTH, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without documents that windows of `least_items` items or more occur in (remove="documents"), or with such documents' hit spans cut out of their texts (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    names = [c for c in docs.columns if c not in RESULT or c == text_col]
    found = scan(docs.select(*names), benchmark, width, text_col, item_id, item_text)
    bad = F.col("contaminated") & (F.col("n_items") >= least_items)
    if remove == "documents":
        return found.filter(~bad).select(*names)
    clean = F.when(bad, without(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col)).alias(text_col)
    return found.select(*(clean if c == text_col else F.col(c) for c in names))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document its words, hits and items, these as one hash."""
    return found.select(F.col(id_col).alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
