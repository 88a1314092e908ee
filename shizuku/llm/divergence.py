"""Source divergence audit: how far the word use of each source of a language is from every other one, and by which terms.

A language keeps its V terms that occur in at least MIN_DOCS of its documents. A group, a source of a language, gives a kept term
with `count` occurrences p = 1 + floor(SCALE * (count + 1) / (N + V)), where N is the group's sum of counts; the language itself gives
q in the same way. Two such shares diverge in a term by f(p, q) = floor((p - q)**2 / q).

The pairs come from an inverted index with a corrected baseline. A posting list, one row a term, has the term's groups with their counts;
groups without the term aren't in it, and all of those have the one share z of a zero count. So each pair of groups (a, b) starts
at V * f(z_a, z_b), as if no term occurred in either. A term of a that b may not have changes that by f(p_a, z_b) - f(z_a, z_b), which depends
on its count alone, so these corrections are added up over the counts that a has, not over its terms; likewise for b. A
term of both, a pair of entries of one posting list, adds what is left of f(p_a, p_b). Nothing is emitted for other terms.

Terms are ranked within their group by a window whose limit Spark applies before the shuffle, so a group with a third of all
postings sends each task's first LISTED terms only. Sums are exact: all is integers, and counts times SCALE are divided in two steps
that don't pass 64 bits while a group's N + V stays under 2.8e14 (else the query fails, as do sums beyond 64 bits, which
take a language of some 5e8 kept terms).

Defined cases: null lang, source and text count as ''; repeated rows and equal ids are documents each; groups without any kept term have N = 0
and are compared like all others; a language without kept terms has pairs of value 0 and no terms; a language of one
source has no pairs; equal values rank by item in UTF-8 order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shizuku.llm.common import bound, dropped, saved, small
from shizuku.llm.decontaminate import lowered

#: Documents that a kept term occurs in at least, the scale of shares, and terms listed for a group.
MIN_DOCS, SCALE, LISTED = 3, 1_000_000_000, 200
#: What stands between terms of a lower-cased text.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
#: SCALE as two factors, and the most that N + V may be for exact division.
_STEPS, _MOST = (31_250, 32_000), 280_000_000_000_000


def terms(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), exactly; null where there are no terms."""
    of = n + v
    first = lambda x: (x["c"] + 1) * _STEPS[0]
    div = lambda a, b: F.call_function("div", a, b)
    whole = lambda x: 1 + div(first(x), x["of"]) * _STEPS[1] + div(F.pmod(first(x), x["of"]) * _STEPS[1], x["of"])
    checked = F.when(of > _MOST, F.raise_error(F.lit("a group has more words than its shares can be calculated of exactly")).cast("long")).otherwise(of)
    return F.when(v > 0, bound(F.struct(count.alias("c"), checked.alias("of")), whole))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents)."""
    ts = terms(F.coalesce(F.col(text), F.lit("")))
    both = bound(ts, lambda t: F.array(F.struct(F.lit(1).alias("o"), t.alias("ts")), F.struct(F.lit(0).alias("o"), F.array_distinct(t).alias("ts"))))
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.explode(both).alias("b"))
    words = named.select("lang", "source", F.col("b.o").alias("o"), F.explode("b.ts").alias("term"))
    return words.groupBy("lang", "source", "term").agg(F.sum("o").alias("n"), (F.count("*") - F.sum("o")).alias("d"))


def index(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n (in the language) and its posting list `at`, an array of (source, n), of the kept terms."""
    by = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("at"))
    return by.filter(F.col("d") >= min_docs).select("lang", "term", "n", "at")


def groups_of(docs: DataFrame, postings: DataFrame, lang: str, source: str) -> DataFrame:
    """lang, source, n, v, all_n (the language's) and z, the share of a term that doesn't occur, of every group. postings: lang, source, n."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    return named.join(sums, ["lang", "source"], "left").fillna(0, ["n"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows for all other sources of the language, `term` rows for the group's first terms."""
    lists = saved(index(counted(docs, lang, source, text), min_docs), "postings")
    entries = lists.select("lang", "term", F.col("n").alias("all_n"), F.explode("at").alias("e")).select("lang", "term", "all_n", "e.source", "e.n")
    whole = lists.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    groups = groups_of(docs, entries, lang, source).join(whole, "lang", "left").fillna(0, ["v", "lang_n"])
    groups = saved(groups.withColumn("z", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))), "groups")
    own = small(groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n", "z"))

    known = entries.join(own, ["lang", "source"])
    shares = saved(known.select("lang", "term", "source", "n", "z", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q")), "shares")
    out = pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    listing = leading(shares, listed).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    result = saved(out.unionByName(listing), "divergence")
    dropped(lists, groups, shares)
    return result


def leading(shares: DataFrame, listed: int) -> DataFrame:
    """The terms whose share exceeds the language's, those that diverge most first."""
    found = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """value and rank of every other group of the language, for every group."""
    p, z = lambda x: F.col(f"{x}.p"), lambda x: F.col(f"{x}.z")
    entry = F.struct("source", "p", "z")
    lists = shares.groupBy("lang", "term").agg(F.collect_list(entry).alias("at")).filter(F.size("at") > 1)
    meeting = lists.select("lang", "at", F.explode("at").alias("a")).select("lang", "a", F.explode("at").alias("b")).filter("a.source <> b.source")
    left = gap(p("a"), p("b")) - gap(p("a"), z("b")) - gap(z("a"), p("b")) + gap(z("a"), z("b"))
    both = meeting.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(left).alias("e"))

    # By count, not by term: how many terms of a group have a share.
    levels = saved(shares.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("terms")), "levels")
    other = small(groups.filter("v > 0").select("lang", F.col("source").alias("item"), F.col("z").alias("zo")))
    one = levels.join(other, "lang").filter(F.col("source") != F.col("item"))
    base = gap(F.col("z"), F.col("zo"))
    ahead = one.groupBy("lang", "source", "item").agg(F.sum((gap(F.col("p"), F.col("zo")) - base) * F.col("terms")).alias("e"))
    # The same terms from the other side: there the baseline is that of the pair turned around.
    turned = one.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum((gap(F.col("zo"), F.col("p")) - gap(F.col("zo"), F.col("z"))) * F.col("terms")).alias("e"))

    mine = groups.select("lang", "source", "v", "z")
    start = mine.join(small(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zo"))), "lang").filter(F.col("source") != F.col("item"))
    start = start.select("lang", "source", "item", F.coalesce(F.col("v") * base, F.lit(0)).alias("e"))
    value = start.unionByName(both).unionByName(ahead).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("e").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.withColumn("rank", F.row_number().over(order))
