"""Connected components of an edge table: edges are contracted task by task, then joined in large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shizuku.llm.common import dropped, saved

#: Edges, and nodes, that a task contracts at once.
CHUNK = 500_000


def contracted(nodes: int, whole: bool = False):
    """Edges (u, v) that join what those of a task join, each from a node to the smallest one of its group; with `whole`, (root, root) as well. About `nodes` nodes are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        kind = None

        def find(x):
            while (up := root[x]) != x:
                root[x] = root[up]
                x = up
            return x

        def out() -> pa.RecordBatch:
            found = [(x, y) for x in root if (y := find(x)) != x or whole]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], names=["u", "v"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > nodes and not whole:
                yield out()
                root.clear()
        if root:
            yield out()

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for every node with an edge the smallest node that it can reach. Nodes can be of any type that sorts.

    Edges first go through tasks of about CHUNK each, which keep no more than a tree of every group they see. Where there is one
    such task, that is the result. Else rounds relink every node to the smallest of its neighbours; their number grows with
    the logarithm of the longest path. A node's neighbours are only ever folded to a minimum, never gathered. Minima are saved
    by themselves, so that joining them to the edges is a plain join of two tables: broadcast where Spark's own threshold
    allows, and else shuffled, where adaptive execution splits a hub's edges.
    """
    kind = dict(edges.dtypes)[a]
    pairs = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "edges")
    tasks = -(-max(1, pairs.count()) // CHUNK)
    fewer = saved(pairs.coalesce(tasks).mapInArrow(contracted(CHUNK, tasks == 1), f"u {kind}, v {kind}"), "edges")
    dropped(pairs)
    if tasks == 1:
        return fewer.select(F.col("u").alias("node"), F.col("v").alias("root"))
    pairs, state = fewer, None
    while True:
        # Large star: the larger neighbours of a node go to the smallest node around it.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = saved(both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        dropped(pairs, low)
        pairs = saved(near.distinct(), "edges")
        dropped(large, least)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = saved(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
    dropped(pairs)
    return out
