"""Line dedup by winnowing over line hashes: later copies of repeated runs of lines are deleted.

A document is the sequence of its lines, where a line of several sentences counts as one line for each (text from the web is often
not broken into lines), without the blank ones. Every window of lines of MIN_WORDS words, or just more, selects its smallest line
hash. The stretch of as many words from the selected line on (at the document's end, the last one there is) is hashed
as a fingerprint. So two documents that share a run of two such windows, about SURE_WORDS words, share a fingerprint in it.

A fingerprint's position is joined with the earliest one of the same hash in the corpus, found by a pre-aggregated minimum,
never with all; further positions in the same document are joined with the one before. Each join gives two documents and how
far they are shifted against one another. Along that shift the lines of both are compared, so a match goes on both ways as far as the
lines are equal in one earlier place; runs of MIN_WORDS words or more go. A line's first copy always stays, because what goes
has an equal line before it, in order of doc_id, then place. Only DataFrame functions are used.

Defined cases: null texts stay null and take no part; empty texts stay; blank lines take no part in runs, and those that
follow a deleted line go with it; null ids come first; rows with the same id and text count as one document and all get its result;
of rows with the same id and other texts, the text with the smaller hash counts as earlier. Columns of the input named like
`n_lines` and `removed` give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shizuku.llm.common import WORD, bound, dropped, saved, small

#: Least words of a run that is deleted; a run is sure to be found if it holds a window and, from its last line on, a stretch, so about twice as many words.
MIN_WORDS = 25
SURE_WORDS = 2 * MIN_WORDS
#: Lines that the words of a stretch are looked for in at first; longer ones take a second step.
AHEAD = 6
#: Where a line of several sentences is divided.
SENTENCE_END = r"(?<=[.!?]) "


def split_lines(text: Column) -> Column:
    """All lines as (line, text), in order: `line` counts line ends, so lines that are sentences of one share it."""
    parts = F.transform(F.split(text, "\n"), lambda x, i: F.transform(F.split(x, SENTENCE_END), lambda part: F.struct(i.alias("line"), part.alias("text"))))
    return F.flatten(parts)


def _words(line: Column) -> Column:
    """How many words a line has: single spaces are counted; the pattern is for lines with other white space or several spaces in a row."""
    odd = F.contains(line, F.lit("  "))
    for space in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(space))
    at_ends = F.startswith(line, F.lit(" ")).cast("int") + F.endswith(line, F.lit(" ")).cast("int")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1 - at_ends)


def _count(text: Column) -> Column:
    """How many lines split_lines gives."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    for mark in ".!?":
        ends = ends + ((F.length(text) - F.length(F.replace(text, F.lit(f"{mark} "), F.lit("")))) / 2).cast("int")
    return ends + 1


def _hex(text: Column) -> Column:
    """60 bits of the MD5 digest as 15 hexadecimal digits, which sort like the number."""
    return F.substring(F.md5(text), 1, 15)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def stretch_lines(scaled: Column, i: Column, least: int) -> Column:
    """How many lines from the i-th on have `least` words or just more; null if the rest of the document has fewer. scaled: words times 2**16."""
    enough = least << 16
    # Words in the upper bits, lines in the lower ones; lines beyond the stretch aren't counted.
    step = lambda so_far, x: so_far + x + F.when(so_far < enough, 1).otherwise(0)
    of = lambda n: F.aggregate(F.slice(scaled, i + 1, n), F.lit(0).cast("long"), step)
    lines = lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int")
    return bound(of(AHEAD), lambda x: F.when(x >= enough, lines(x)).otherwise(bound(of(least), lambda y: F.when(y >= enough, lines(y)))))


def selected(digits: Column, h: Column, w: Column, least: int) -> Column:
    """The fingerprints (g, i) of a document with line hashes h, their digits and words w: the stretch's hash and its place, sorted."""
    places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))

    def windows(lines: Column) -> Column:
        """Places of the smallest line hash of every window, the first of equal ones; behind the last place where a stretch can begin, that one."""
        first = lambda s: F.array_position(s, F.array_min(s)).cast("int")
        return F.array_distinct(F.transform(lines, lambda n, i: F.least(i + first(F.slice(h, i + 1, n)) - 1, F.size(lines) - 1)))

    def prints(lines: Column) -> Column:
        hash_of = lambda p: _number(_hex(F.array_join(F.slice(digits, p + 1, F.get(lines, p)), "")))
        return F.sort_array(F.transform(windows(lines), lambda p: F.struct(hash_of(p).alias("g"), p.alias("i"))))

    # Stretches begin at all lines but the last few.
    scaled = F.transform(w, lambda x: x.cast("long") * (1 << 16))
    lines = bound(scaled, lambda ws: F.filter(F.transform(places, lambda i: stretch_lines(ws, i, least)), lambda n: n.isNotNull()))
    return bound(lines, prints)


def marked(docs: DataFrame, least: int) -> DataFrame:
    """id, th, h and w of a document's lines, `own`: its fingerprints (g, i), each at its first place, and `again`: shifts of further places against the one before. docs: id, th, text."""
    # The same pieces as split_lines gives, without the blank ones; replacing and splitting at one character need no pattern.
    text = F.col("text")
    for mark in ".!?":
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\v\f\r")) != "")
    line_of = bound(lines, lambda ts: F.struct(F.transform(ts, _hex).alias("d"), F.transform(ts, _words).alias("w")))
    rows = docs.filter("text IS NOT NULL").select("id", "th", line_of.alias("l"))

    def placed(picks: Column) -> Column:
        gap = lambda x, i: F.when(i > 0, F.when(F.get(picks, i - 1)["g"] == x["g"], x["i"] - F.get(picks, i - 1)["i"]))
        marks = F.transform(picks, lambda x, i: F.struct(x["g"].alias("g"), x["i"].alias("i"), gap(x, i).alias("gap")))
        own = lambda ms: F.transform(F.filter(ms, lambda m: m["gap"].isNull()), lambda m: F.struct(m["g"], m["i"]))
        again = lambda ms: F.array_distinct(F.filter(F.transform(ms, lambda m: m["gap"]), lambda x: x.isNotNull()))
        return bound(marks, lambda ms: F.struct(own(ms).alias("own"), again(ms).alias("again")))

    numbered = bound(F.struct(F.col("l.d").alias("d"), F.transform("l.d", _number).alias("h"), F.col("l.w").alias("w")), lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"), bound(selected(x["d"], x["h"], x["w"], least), placed).alias("p")))
    return rows.select("id", "th", numbered.alias("f")).select("id", "th", "f.h", "f.w", "f.p.own", "f.p.again")


def equal_runs(h: Column, w: Column, base: Column, shift: Column, least: int) -> Column:
    """(first, last) of the runs of `least` words or more in which line p of h equals line p - shift of base."""
    lo, hi = F.greatest(F.lit(0), shift), F.least(F.size(h), F.size(base) + shift)
    differ = F.filter(F.sequence(lo, hi - 1), lambda p: F.get(h, p) != F.get(base, p - shift))

    def between(ends: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.struct((F.get(ends, k - 1) + 1).alias("first"), (F.get(ends, k) - 1).alias("last")))
        return F.filter(gaps, lambda x: F.aggregate(F.slice(w, x["first"] + 1, F.greatest(F.lit(0), x["last"] - x["first"] + 1)), F.lit(0), lambda s, y: s + y) >= least)

    none = F.array().cast("array<struct<first:int,last:int>>")
    return F.when(lo < hi, bound(F.concat(F.array(lo - 1), differ, F.array(hi)), between)).otherwise(none)


def runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """id, th, cut: array of (first, last) places among the document's lines, without blank ones, that repeat earlier lines. docs: id, th, text."""
    known = saved(marked(docs, least), "line-marks")
    keys = known.select("id", "th", F.explode("own").alias("o")).select("id", "th", F.col("o.g").alias("g"), F.col("o.i").alias("i"))
    first = keys.groupBy("g").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "i")).alias("first")).filter("n > 1").drop("n")
    first = saved(first, "line-firsts")
    later = F.struct("id", "th") > F.struct(F.col("first.id").alias("id"), F.col("first.th").alias("th"))
    hits = keys.join(small(first), "g").filter(later).select("id", "th", F.col("first.id").alias("id0"), F.col("first.th").alias("th0"), (F.col("i") - F.col("first.i")).alias("shift"))
    inside = known.filter(F.size("again") > 0).select("id", "th", F.col("id").alias("id0"), F.col("th").alias("th0"), F.explode("again").alias("shift"))
    pairs = saved(hits.unionByName(inside).groupBy("id", "th", "id0", "th0").agg(F.collect_set("shift").alias("shifts")), "line-pairs")
    dropped(first)

    # The lines of the documents that meet, one row a document.
    met = pairs.select("id", "th").unionByName(pairs.select(F.col("id0").alias("id"), F.col("th0").alias("th")))
    met = saved(met.distinct().select(F.col("id").alias("m_id"), F.col("th").alias("m_th")), "line-docs")
    on = lambda a, b: F.col(a).eqNullSafe(F.col(f"{b}_id")) & (F.col(a.replace("id", "th")) == F.col(f"{b}_th"))
    held = saved(known.join(small(met), on("id", "m"), "left_semi").select("id", "th", "h", "w").dropDuplicates(["id", "th"]), "line-hashes")
    named = lambda name, *cols: held.select(F.col("id").alias(f"{name}_id"), F.col("th").alias(f"{name}_th"), *(F.col(c).alias(f"{name}_{c}") for c in cols))
    both = pairs.join(named("own", "h", "w"), on("id", "own")).join(named("base", "h"), on("id0", "base"))
    found = F.flatten(F.transform("shifts", lambda s: equal_runs(F.col("own_h"), F.col("own_w"), F.col("base_h"), s, least)))
    spans = saved(both.select("id", "th", F.explode(found).alias("r")).select("id", "th", "r.first", "r.last").distinct(), "line-spans")
    dropped(known, pairs, met, held)

    # Runs that touch or overlap are one.
    order = Window.partitionBy("id", "th").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(F.col("first") <= before + 1, 0).otherwise(1))
    island = island.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = island.groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cut"))


def without(text: Column, cut: Column) -> Column:
    """(text, n_lines, removed) of a text without the runs `cut`: removed has first and last of all lines, blank ones counted, and the words."""

    def lines_of(all_lines: Column) -> Column:
        counted = F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), _words(x["text"]).alias("w")))
        return bound(F.filter(counted, lambda x: x["w"] > 0), lambda full: removed_of(all_lines, full))

    def removed_of(all_lines: Column, full: Column) -> Column:
        def span(c: Column) -> Column:
            after = F.coalesce(F.get(full, c["last"] + 1)["i"], F.size(all_lines))
            words = F.aggregate(F.slice(full, c["first"] + 1, c["last"] - c["first"] + 1), F.lit(0), lambda s, x: s + x["w"])
            return F.struct(F.get(full, c["first"])["i"].alias("first"), (after - 1).alias("last"), words.alias("words"))

        return bound(F.transform(cut, span), lambda gone: F.struct(rest_of(all_lines, gone).alias("text"), F.size(all_lines).alias("n_lines"), gone.alias("removed")))

    def rest_of(all_lines: Column, gone: Column) -> Column:
        start = lambda j: F.when(j > 0, F.get(gone, j - 1)["last"] + 1).otherwise(0)
        stop = lambda j: F.coalesce(F.get(gone, j)["first"], F.size(all_lines))
        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(all_lines, start(j) + 1, F.greatest(F.lit(0), stop(j) - start(j)))))
        space = lambda rest, x, i: F.when(i == 0, "").when(F.get(rest, i - 1)["line"] == x["line"], " ").otherwise("\n")
        return bound(kept, lambda rest: F.array_join(F.transform(rest, lambda x, i: F.concat(space(rest, x, i), x["text"])), ""))

    return bound(split_lines(text), lines_of)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text without its repeated runs, n_lines, and removed: array of (first, last, words) in lines of the text before."""
    rows = docs.withColumn("__text", F.col(text_col)).withColumn("__th", F.xxhash64(text_col))
    cuts = saved(runs(rows.select(F.col(id_col).alias("id"), F.col("__th").alias("th"), F.col("__text").alias("text")), min_words), "line-runs")
    cuts = cuts.select(F.col("id").alias("__id"), F.col("th").alias("__h"), F.col("cut").alias("__cut"))
    joined = rows.join(small(cuts), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    done = F.when(F.col("__cut").isNotNull(), without(F.col("__text"), F.col("__cut")))
    out = joined.withColumn("__done", done)
    count = F.coalesce(F.col("__done.n_lines"), _count(F.col("__text")))
    others = [c for c in docs.columns if c not in ("n_lines", "removed")]
    clean = F.when(F.col("__done").isNotNull(), F.col("__done.text")).otherwise(F.col("__text")).alias(text_col)
    return out.select(
        *(clean if c == text_col else F.col(c) for c in others),
        F.when(F.col("__text").isNull(), 0).otherwise(count).alias("n_lines"),
        F.coalesce("__done.removed", F.array().cast("array<struct<first:int,last:int,words:int>>")).alias("removed"),
    )


def digest(clean: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its lines, how many went, and length and hash of the text that is left."""
    gone = F.aggregate("removed", F.lit(0), lambda s, x: s + x["last"] - x["first"] + 1)
    return clean.select(F.col(id_col).alias("doc_id"), "n_lines", gone.alias("removed_lines"), F.length(text_col).cast("long").alias("kept_chars"), F.sha2(F.col(text_col).cast("binary"), 256).alias("kept_sha256"))
