"""Joins by time against brute force, with hot keys, ties, open ends and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from shizuku.operators import temporal


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (5, 5), (5, 4), (0, 1), (3, 17), (15, 16), (0, 16), (1, 300), (255, 4097), (-40, 40), (-5000, 70_001), (0, 16**5), (7, 2 * 16**5 + 3)])
def test_blocks_together_are_the_range(spark, lo, hi):
    got = spark.range(1).select(temporal.blocks(F.lit(lo).cast("long"), F.lit(hi).cast("long")).alias("b")).first()["b"]
    ends = sorted((b["block"] * temporal.STEP ** b["size"], (b["block"] + 1) * temporal.STEP ** b["size"]) for b in got)
    assert len(got) <= 2 * temporal.STEP * temporal.SIZES
    if lo >= hi:
        assert got == []
    else:
        assert ends[0][0] == lo and ends[-1][1] == hi and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_ranges_that_hold_a_point(spark):
    draw = random.Random(2)
    key = lambda: draw.choice(["hot", "hot", "hot", "b", None])
    points = [(i, key(), draw.choice([None, draw.randrange(-50, 3000)])) for i in range(400)]
    ranges = []
    for i in range(120):
        a = draw.choice([None, draw.randrange(-100, 3200)])
        ranges.append((i, key(), a, draw.choice([None, (a or 0) + draw.randrange(-3, 900)])))
    p, r = spark.createDataFrame(points, "p int, k string, at int"), spark.createDataFrame(ranges, "r int, k string, a int, b int")
    want = sorted((i, j) for i, k, t in points for j, q, a, b in ranges if k is not None and k == q and t is not None and (a is None or a <= t) and (b is None or t < b))
    got = sorted((x.p, x.r) for x in temporal.valid_at(p, r, ["k"], "at", "a", "b").collect())
    assert got == want and want
    assert temporal.valid_at(p.limit(0), r, ["k"], "at", "a", "b").count() == 0 and temporal.valid_at(p, r.limit(0), ["k"], "at", "a", "b").count() == 0


def test_last_before(spark):
    draw = random.Random(4)
    key = lambda: draw.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(i, key(), draw.choice([None, *[draw.randrange(200) for _ in range(9)]])) for i in range(500)] + [(0, "hot", 5), (0, "hot", 5)]
    right = [(key(), draw.choice([None, *[draw.randrange(10, 190) for _ in range(9)]]), draw.choice(["x", "y", None]), i) for i in range(150)] + [("hot", 50, "x", 1), ("hot", 50, "x", 1)]
    df, to = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, s int, v string, j int")
    low = lambda v: (v is not None, v or "")
    want = []
    for i, k, t in left:
        fit = [r for r in right if r[0] is not None and r[0] == k and t is not None and r[1] is not None and r[1] <= t]
        want.append((i, k, t, max(fit, key=lambda r: (r[1], low(r[2]), r[3])) if fit else None))
    for slices in (1, 3, 128):
        got = [(x.i, x.k, x.t, tuple(x.found) if x.found else None) for x in temporal.as_of(df, to, ["k"], "t", "s", slices).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), slices
    assert temporal.as_of(df.limit(0), to, ["k"], "t", "s").count() == 0
    assert {x.found for x in temporal.as_of(df, to.limit(0), ["k"], "t", "s").collect()} == {None}


def test_editions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 2, None)], "k string, since int, v string")
    assert sorted(map(tuple, temporal.editions(rows, ["k"], "since").collect())) == [("a", 1, 5, "x"), ("a", 5, None, "z"), ("b", 2, None, None)]
