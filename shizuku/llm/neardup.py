"""Near duplicates of documents: MinHash signatures joined by Hamming distance with a multi-index, confirmed on full sets.

1. A document's set of word shingles gives a signature of SLOTS numbers of 16 bits, each from one min-wise hash. Documents
   with equal sets are one class, known by a number.
2. Signatures are split into chunks of CHUNK slots. By the pigeonhole principle two signatures within a distance of d slots have
   a chunk with at most d * CHUNK / SLOTS errors, so every chunk is listed once for each choice of slots to leave out that
   allows them: all pairs within the distance meet in a bucket. `distance_of` sets it by the similarity: sets of a similarity of 0.8
   differ in 6.4 of 32 slots on average and in more than the 15 that are allowed with a probability of 1.4e-4.
3. Within a bucket all signatures within the distance are linked: a pair is left out only if links join it already.
   Linked classes form families.
4. Within a family all sets are compared exactly, but for pairs that confirmed links join already. Components of the confirmed
   links are the result.

Nothing is capped. A bucket or family beyond a block's size is dealt to blocks in two passes (`first_pass`,
`second_pass`): each block with itself and with a few pivots, which joins what is alike at a cost that grows with the
rows; then only the rows that aren't in the largest group so far, with all blocks. Tasks give links that join groups, never
all pairs.

Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing; texts with fewer
words than a shingle are one shingle; rows that share an id are documents of their own with that id; a null id is never
smallest unless all ids of its component are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shizuku.llm.common import dropped, give_back, saved, small
from shizuku.llm.components import components

SLOTS, CHUNK = 32, 4
#: Classes in a block of a bucket, documents and shingles in a block of a family, about; pivots that every block of one meets.
BUCKET_ROWS, BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 512, 256, 300_000, 4
#: Distinct shingles compared at once, words whose hashes a worker keeps.
COLUMNS, KEPT = 16_384, 100_000
_SEED = np.random.default_rng(20240229)
_MULT = _SEED.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int, kept: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text. Only A-Z are lower-cased; words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    try:
        got = list(map(kept.__getitem__, words))
    except KeyError:
        if len(kept) > KEPT:
            kept.clear()
        for w in words:
            if w not in kept:
                kept[w] = xxhash.xxh3_64_intdigest(w)
        got = list(map(kept.__getitem__, words))
    h = np.array(got, np.uint64)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mixed(out * _P + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray) -> bytes:
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        low = np.minimum(low, (_MULT[:, None] * s[None, i : i + 8192] + _ADD[:, None]).min(1))
    return (_mixed(low) >> np.uint64(48)).astype("<u2").tobytes()


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.num_columns - 1).to_pylist()


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), node (digest of the set), sig; the last two null for empty sets. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            n, node, sig = [], [], []
            for text in _texts(batch):
                s = shingles(text, width, kept)
                n.append(len(s))
                node.append(digest(s) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "node", "sig"])
        kept.clear()
        give_back()

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, node binary, sig binary")


def distance_of(similarity: float) -> int:
    """Slots that signatures of sets of this similarity differ in at most, but for one pair in some seven thousand."""
    return min(SLOTS - 1, math.floor(SLOTS * (1 - similarity) + 4 * math.sqrt(SLOTS * similarity * (1 - similarity))))


def chunk_keys(distance: int) -> list:
    """Columns of the bucket keys of a signature `sig`: all pairs within the distance share one."""
    errors = distance // (SLOTS // CHUNK)
    keys = []
    for start in range(0, SLOTS, CHUNK):
        for n, kept in enumerate(combinations(range(CHUNK), CHUNK - errors)):
            keys.append(F.xxhash64(F.lit(1000 * start + n), *(F.substring("sig", 2 * (start + k) + 1, 2) for k in kept)))
    return keys


def joined(c: np.ndarray, label: np.ndarray, sig: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the rows of one task within the distance, where rows of one label are joined already."""
    _, group = np.unique(label, return_inverse=True)
    left, out = np.arange(len(c)), []
    while len(left) > 1 and (group[left] != group[left[0]]).any():
        # A row of the smallest group meets the rows of all others; then it has met all, and goes.
        lead = left[np.bincount(group)[group[left]].argmin()]
        left = left[left != lead]
        other = left[group[left] != group[lead]]
        hit = other[np.count_nonzero(sig[other] != sig[lead], axis=1) <= distance]
        if len(hit):
            groups, one = np.unique(group[hit], return_index=True)
            out += [(int(c[lead]), int(c[i])) for i in hit[one]]
            group[np.isin(group, groups)] = group[lead]
    return out


def near(distance: int):
    """Links a, b from rows (task, c, label, sig) sorted by task. A task holds some blocks of one bucket."""

    def links(task, c, label, sig) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(task)))
        one = start[size == 2]  # most buckets: all at once
        one = one[(label[one] != label[one + 1]) & (np.count_nonzero(sig[one] != sig[one + 1], axis=1) <= distance)]
        found = list(zip(c[one].tolist(), c[one + 1].tolist(), strict=True))
        for lo, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            part = slice(lo, lo + n)
            _, own = np.unique(c[part], return_index=True)  # pivots are in a block, too
            found += joined(c[part][own], label[part][own], sig[part][own], distance)
        return _links(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3 + [np.empty((0, SLOTS), np.uint16)]
        for batch in batches:
            got = [np.asarray(batch.column(i)) for i in range(3)]
            got.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(-1, SLOTS))
            rows = [np.concatenate(x) for x in zip(held, got, strict=True)]
            last = np.searchsorted(rows[0], rows[0][-1], "left") if len(rows[0]) else 0  # the last task may go on
            held = [x[last:].copy() for x in rows]
            yield links(*(x[:last] for x in rows))
        yield links(*held)
        give_back()

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    found = [x for x in found if x[0] != x[1]]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def first_pass(rows: DataFrame) -> DataFrame:
    """(task, c, label, payload): each block of a group g by itself, with the group's pivots. rows: g, blocks, c, payload."""
    task = F.xxhash64("g", F.pmod(F.xxhash64("c"), F.col("blocks")))
    own = rows.select(task.alias("task"), "c", F.col("c").alias("label"), "payload")
    hot = rows.filter("blocks > 1")
    chosen = hot.groupBy("g").agg(F.max("blocks").alias("blocks"), F.array(*(F.min(F.when(F.pmod(F.xxhash64(F.lit("pivot"), "c"), F.lit(PIVOTS)) == k, F.col("c"))) for k in range(PIVOTS))).alias("pivots"))
    chosen = chosen.select("g", "blocks", F.explode("pivots").alias("c")).filter("c IS NOT NULL")
    pivots = hot.select("g", "c", "payload").join(chosen, ["g", "c"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return own.unionByName(pivots.select(F.xxhash64("g", "block").alias("task"), "c", F.col("c").alias("label"), "payload"))


def second_pass(rows: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(task, c, label, payload): in groups of several blocks that aren't one component yet, the rows outside of their largest component with all rows. labels: node, root."""
    hot = rows.filter("blocks > 1")
    if not hot.limit(1).count():
        return None
    known = saved(hot.join(labels.select(F.col("node").alias("c"), "root"), "c", "left").select("g", "blocks", "c", F.coalesce("root", "c").alias("label"), "payload"), "hot-rows")
    parts = known.groupBy("g", "label").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    split = parts.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("blocks").alias("all"), (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("n")).filter("others > 0")
    split = saved(split.select("g", "main", "all", F.ceil(F.col("others") * F.col("all") / F.col("n")).alias("some")), "hot-groups")
    if not split.limit(1).count():
        return None
    placed = known.join(small(split), "g")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = placed.withColumn("i", F.pmod(F.xxhash64("c"), F.col("all"))).withColumn("j", upto("some"))
    rest = placed.filter("label <> main").withColumn("j", F.pmod(F.xxhash64(F.lit("rest"), "c"), F.col("some"))).withColumn("i", upto("all"))
    both = every.unionByName(rest.select(*every.columns))
    return both.select(F.xxhash64("g", "i", "j").alias("task"), "c", "label", "payload")


def passes(rows: DataFrame, compare, known: DataFrame | None = None) -> DataFrame:
    """node, root: components of the links that `compare` finds in the groups of rows (g, blocks, c, payload)."""
    dealt = lambda tasks: tasks.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long")
    labels = components(dealt(first_pass(rows)), "a", "b")
    tasks = second_pass(rows, labels)
    if tasks is None:
        return labels
    return components(dealt(tasks).unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")


def families(classes: DataFrame, distance: int) -> DataFrame:
    """node, root: classes (c, sig) by component of the links within the distance."""
    listed = classes.select("c", F.explode(F.array(*chunk_keys(distance))).alias("g"))
    shared = saved(listed.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g", F.ceil(F.col("n") / BUCKET_ROWS).alias("blocks")), "shared-buckets")
    met = saved(listed.join(shared, "g"), "bucket-rows")
    rows = saved(met.join(classes.select("c", F.col("sig").alias("payload")), "c").select("g", "blocks", "c", "payload"), "bucket-signatures")
    dropped(shared, met)
    found = passes(rows, near(distance))
    dropped(rows)
    return found


def linked(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join the pairs with 100 * intersection >= percent * union, where sets of one label are joined already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids = np.repeat(np.arange(n), sizes)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    ids, inverse = ids[shared], inverse[shared]
    columns = np.cumsum(counts > 1) - 1
    column = columns[inverse]
    both = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    ids, column = ids[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        m[ids[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    good = np.triu(100 * both >= percent * union, 1)
    first: dict[int, int] = {}
    root = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(good), strict=True):
        x, y = find(int(a)), find(int(b))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def confirmed(percent: int):
    """Links a, b from rows (task, c, label, set) sorted by task. A task holds some blocks of one family."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())  # pivots are in a block, too
        if len(rows) < 2:
            return []
        found = linked([np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows], percent)
        return [(rows[a][0], rows[b][0]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            out = []
            for t, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != task:
                    out += links(rows)
                    task, rows = t, []
                rows.append(row)
            yield _links(out)
        yield _links(links(rows))
        rows.clear()
        give_back()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = saved(signed(rows, width), "signatures")
    # A signature is a function of the set: all rows of a class have the same.
    classes = known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("docs"))
    classes = saved(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers are fixed from here on
    loose = families(classes.select("c", "sig"), distance_of(percent / 100))

    # The sets of the classes in families, from the texts of their first documents.
    members = saved(loose.join(classes.select(F.col("c").alias("node"), F.col("node").alias("set_id"), "rep"), "node").select("root", F.col("node").alias("c"), "set_id", "rep"), "families")
    wanted = saved(members.select(F.col("rep").alias("__rep")).distinct(), "family-reps")
    texts = rows.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            found = [shingles(t, width, kept) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.large_binary()).cast(pa.binary())], names=["set_id", "payload"])
            del found
        kept.clear()
        give_back()

    sets = texts.mapInArrow(gather, "set_id binary, payload binary")
    sets = saved(members.select(F.col("root").alias("g"), "c", "set_id").join(sets, "set_id").dropDuplicates(["c"]), "family-sets")
    sizes = sets.groupBy("g").agg(F.count("*").alias("docs"), F.sum(F.length("payload") / 8).alias("shingles")).filter("docs > 1")
    blocks = F.least("docs", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("long")
    placed = saved(sets.join(small(saved(sizes.select("g", blocks.alias("blocks")), "family-blocks")), "g").select("g", "blocks", "c", "payload"), "family-blocks")
    dropped(sets)
    tight = passes(placed, confirmed(percent))
    dropped(placed, members, wanted)

    # Classes without links are components of their own; all ids of a component fold to the smallest. Only documents whose
    # component isn't named by themselves need to be told.
    groups = tight.join(classes.select(F.col("c").alias("node"), F.col("node").alias("set_id"), "rep"), "node")
    first = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = groups.join(first, "root").filter(~F.col("rep").eqNullSafe(F.col("component_id"))).select("set_id", F.struct("component_id").alias("told"))
    copies = classes.filter("docs > 1").select(F.col("node").alias("set_id"), F.struct(F.col("rep").alias("component_id")).alias("told"))
    told = saved(named.unionByName(copies.join(named.select("set_id"), "set_id", "left_anti")), "component-names")
    own = known.join(small(told.withColumnRenamed("set_id", "node")), "node", "left")
    component = F.when(F.col("told").isNull(), F.col("doc_id")).otherwise(F.col("told.component_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
