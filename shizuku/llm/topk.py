"""Exact top-k search by exhaustive term-at-a-time accumulation.

A term is a component of the vectors, its posting list that component of all candidates of a block. A block of queries
goes through the terms one by one: each query with a weight other than zero there scatters weight times postings into
its dense array of scores. Each block then selects its k best by partition selection, and the selections are merged.

Blocks of candidates are dealt to every group of queries, so that no task holds more than one block of each; what a
task puts out is k rows a query for its slice of candidates.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
followed by zeros, so an empty one scores 0 with all; ties go to the smaller id; components or scores beyond 64 bits are errors; repeated
ids take part as rows of their own, and a query never meets a row of its own id; no candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shizuku.llm.common import saved

#: Vectors in a block of candidates, queries in a block, and tasks that the candidate blocks of one query block are dealt to: so many, or one for DEALT blocks.
BLOCK, QUERIES, SLICE, DEALT = 4096, 1024, 8, 64


def packed(rows: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """Rows (ids, terms, kind, postings): blocks of at most `size` usable vectors, postings by term in the narrowest type."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = [], []

        def block():
            width = max(1, max(len(x) for x in held))
            m = np.zeros((width, len(held)), np.float64)
            for i, x in enumerate(held):
                m[: len(x), i] = np.floor(64.0 * x)
            if np.abs(m).max() >= 2.0**63:
                raise ValueError("a component is too large for 64 bits")
            order = np.argsort(np.array(held_ids, np.int64), kind="stable")
            m = m[:, order].astype(np.int64)
            kind = next(t for t in ("int8", "int16", "int32", "int64") if t == "int64" or -np.iinfo(t).max <= m.min() and m.max() <= np.iinfo(t).max)
            return pa.RecordBatch.from_pydict({"ids": [np.array(held_ids, np.int64)[order].tobytes()], "terms": pa.array([width], pa.int32()), "kind": [kind], "postings": [np.ascontiguousarray(m.astype(kind)).tobytes()]})

        for batch in batches:
            for key, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or vec is None or any(x is None for x in vec):
                    continue
                x = np.array(vec, np.float64)
                if np.isfinite(x).all():
                    held_ids.append(key)
                    held.append(x)
                    if len(held) == size:
                        yield block()
                        held_ids, held = [], []
        if held:
            yield block()

    return rows.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(pack, "ids binary, terms int, kind string, postings binary")


def unpacked(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and postings (term, vector) of a block."""
    ids = np.frombuffer(block["ids"], np.int64)
    return ids, np.frombuffer(block["postings"], block["kind"]).reshape(block["terms"], len(ids))


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores (query, candidate) of queries (query, term) and postings (term, candidate), term at a time."""
    terms = min(queries.shape[1], postings.shape[0])
    queries, postings = queries[:, :terms], postings[:terms]
    bound = np.sqrt((queries.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((postings.astype(float) ** 2).sum(0).max(initial=0))
    most = max(np.abs(queries.astype(float)).max(initial=0), np.abs(postings.astype(float)).max(initial=0))
    if bound >= 2.0**62:  # sums may pass 64 bits: whole numbers of any size tell whether they do
        scores = queries.astype(object) @ postings.astype(object)
        if any(abs(x) >= 2**63 for x in scores.flat):
            raise ValueError("a score is too large for 64 bits")
        return scores.astype(np.int64)
    # By Cauchy and Schwarz no sum of some of the products passes the bound: the narrowest type that holds it is exact.
    kind = np.int16 if max(bound, most) < 32_000 else np.int32 if max(bound, most) < 2e9 else np.int64
    postings, queries = postings.astype(kind), queries.astype(kind)
    scores = np.zeros((len(queries), postings.shape[1]), kind)
    part = np.empty(postings.shape[1], kind)
    for i, row in enumerate(queries):
        for term in np.flatnonzero(row):
            np.multiply(postings[term], row[term], out=part)
            scores[i] += part
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best, by partition selection; ids ascend, so places decide ties."""
    n = len(ids)
    rows, picked_ids, picked = [], [], []
    for i, s in enumerate(scores.astype(np.int64)):
        at = np.arange(n)
        lo, hi = np.searchsorted(ids, own[i], "left"), np.searchsorted(ids, own[i], "right")
        if lo < hi:
            at = np.concatenate([at[:lo], at[hi:]])
        s = s[at]
        if len(at) > k:
            floor = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > floor)
            keep = np.concatenate([above, np.flatnonzero(s == floor)[: k - len(above)]])
            at, s = at[keep], s[keep]
        rows.append(np.full(len(at), i))
        picked_ids.append(ids[at])
        picked.append(s)
    return np.concatenate(rows), np.concatenate(picked_ids), np.concatenate(picked)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id long, rank int from 1, vec_id long, score long: the k highest inner products of floor(64 * component)."""
    number = F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())
    groups = max(1, -(-queries.count() // query_block))
    asked = queries.select(id_col, vec_col).repartition(groups, F.xxhash64(id_col))
    asked = saved(packed(asked, id_col, vec_col, 2 * query_block).withColumn("qb", number), "query-blocks")
    deal = saved(packed(vectors, id_col, vec_col, block).withColumn("cb", number), "candidate-blocks")
    # Every query block meets every candidate block: their numbers are paired first, then each side's block joins.
    # The last join leaves a query block's candidates together, dealt to as many tasks as there are slices.
    n = max(SLICE, -(-deal.count() // DEALT))
    slices = deal.select("cb", F.pmod(F.xxhash64("cb"), F.lit(n)).alias("slice"))
    slots = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("slice", F.col("slice").cast("long"))
    right = slots.select("qb", "slice").join(slices, "slice").join(deal.select("cb", F.struct("ids", "terms", "kind", "postings").alias("c")), "cb")
    left = slots.select("qb", "slice", F.struct("ids", "terms", "kind", "postings").alias("q"))
    pairs = right.join(left, ["qb", "slice"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, weights, found = None, None, None, None

        def out():
            rows, ids, scores = found
            return pa.RecordBatch.from_pydict({"query_id": own[rows], "vec_id": ids, "score": scores})

        for batch in batches:
            for i in range(batch.num_rows):
                qb = batch.column("qb")[i].as_py()
                if qb != now:
                    if now is not None:
                        yield out()
                    now = qb
                    own, weights = unpacked(batch.column("q")[i].as_py())
                    weights = np.ascontiguousarray(weights.T)
                    found = tuple(np.empty(0, np.int64) for _ in range(3))
                ids, postings = unpacked(batch.column("c")[i].as_py())
                rows, ids, scores = (np.concatenate(x) for x in zip(found, best(accumulate(weights, postings), ids, own, k), strict=True))
                order = np.lexsort((ids, -scores, rows))
                rows, ids, scores = rows[order], ids[order], scores[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                found = rows[keep], ids[keep], scores[keep]
        if now is not None:
            yield out()

    found = pairs.select("qb", "q", "c").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
