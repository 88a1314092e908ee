import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shizuku.llm import components, linededup, neardup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, (key, _) in enumerate(sets):
        r = find(i)
        least[r] = key if least.get(r) is None else least[r] if key is None else min(key, least[r])
    return sorted((str(key), len(s), str(least[find(i)])) for i, (key, s) in enumerate(sets))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, width):
    rng = random.Random(width)
    rows, n = [], 0
    for base in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for copy in range(rng.choice([1, 2, 5, 30])):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((n, (" " if copy % 3 else "\t").join(w)))
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(df, width=width)) == brute(rows, width)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " end"), (7, long), (None, "x y z q r"), (9, "x y z q r"), (10, "É b c d"), (11, "é b c d"), (12, "nb sp a b c")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, sig string, n int")
    out = neardup.near_duplicates(df, width=4)
    assert got(out) == brute(rows, 4)
    kept = {str(r.doc_id): r.kept for r in out.collect()}
    assert kept["1"] and kept["2"] and kept["4"] and not kept["5"] and not kept["8"] and kept["9"] and not kept["None"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [1, 4])
def test_blocks_of_a_large_family(spark, monkeypatch, pivots):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 5)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(words)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(df, width=4)) == brute(rows, 4)


def test_query_matches_brute_force_on_documents(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert got(queries.op10_near_duplicates(spark, sf_dir)) == brute(rows, 4)


def test_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(db.execute(queries.OP10_SQL).fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op10_near_duplicates(spark, sf_dir).collect()) == want


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def walks(rng, n, most):
    """n signatures in chains: each changes up to `most` slots of an earlier one."""
    sigs = rng.integers(0, 1 << 16, (n, neardup.SLOTS), dtype=np.uint16)
    for i in range(n):
        if i % 25:
            sigs[i] = sigs[i - rng.integers(1, i % 25 + 1)]
            some = rng.choice(neardup.SLOTS, rng.integers(0, most), replace=False)
            sigs[i, some] = rng.integers(0, 1 << 16, len(some))
    return sigs


def task_links(rows, distance, size):
    """Links of rows (task, c, label, sig), in batches of `size` rows."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3].tobytes() for r in rows], pa.binary())], names=["task", "c", "label", "payload"])
    out = neardup.near(distance)(batch[i : i + size] for i in range(0, len(rows), size))
    return [x for b in out for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]


@pytest.mark.parametrize("size", [300, 41, 6, 1])
def test_links_of_a_bucket_join_what_all_pairs_join(size):
    rng = np.random.default_rng(size)
    sigs = walks(rng, 300, 15)
    keys = rng.choice([-5, 3, 3, 3, 8], 300)
    order = sorted(range(300), key=lambda i: (keys[i], rng.random()))
    rows = [(int(keys[i]), i, i, sigs[i]) for i in order]
    every = [(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and (x[3] != y[3]).sum() <= 15]
    links = task_links(rows, 15, size)
    assert roots(range(300), links) == roots(range(300), every)
    assert len(links) == 300 - len(set(roots(range(300), every).values()))


def test_links_between_labels_only():
    sig = np.zeros(neardup.SLOTS, np.uint16)
    rows = [(1, 10, 5, sig), (1, 11, 5, sig), (1, 12, 6, sig), (2, 10, 5, sig), (2, 11, 5, sig)]
    links = task_links(rows, 3, 10)
    assert len(links) == 1 and 12 in links[0]


@pytest.mark.parametrize("rows", [512, 6])
@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_families_hold_all_pairs_within_the_distance(spark, monkeypatch, rows, similarity):
    """Random signatures by brute force, and a pair that a third signature lies between: near the one, far from the other."""
    monkeypatch.setattr(neardup, "BUCKET_ROWS", rows)
    distance = neardup.distance_of(similarity)
    sigs = walks(np.random.default_rng(rows), 300, distance + 3)
    far = np.full((3, neardup.SLOTS), 7, np.uint16)
    far[1, :distance] = 1
    far[2, :distance] = 1
    far[2, neardup.SLOTS - distance :] = 2
    sigs = np.concatenate([sigs, far])
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sigs)], "c long, sig binary")
    every = [(i, j) for i in range(len(sigs)) for j in range(i) if (sigs[i] != sigs[j]).sum() <= distance]
    want = {k: v for k, v in roots(range(len(sigs)), every).items() if any(k in e for e in every)}
    assert {r.node: r.root for r in neardup.families(df, distance).collect()} == want


def test_rows_without_ids_meet_their_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text), (None, text + " x"), (None, "else " * 3)], "doc_id long, text string")
    assert got(neardup.near_duplicates(df, width=4)) == [("5", 57, "5"), ("None", 1, "None"), ("None", 58, "5")]


@pytest.mark.parametrize("chunk", [components.CHUNK, 7, 1])
def test_components_of_paths_and_cycles(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150)]
    out = components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert {r.node: r.root for r in out} == want and len(out) == len(want)
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def lines_sql(db):
    return sorted(map(str, db.execute(queries.OP9_SQL).fetchall()))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_line_dedup_equals_its_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    assert sorted(str(tuple(r)) for r in queries.op9_line_dedup(spark, f"/root/testdata/sf{sf}").collect()) == lines_sql(db)


def test_line_dedup_catches_passages_and_leaves_the_rest(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    parts = "\n".join(" ".join(f"q{j}_{i}" for i in range(14)) for j in range(4))
    short = "a short line that many documents share"
    rows = [(i, f"{short}\nown {i} start\n{passage}\n\nown {i} middle\n{parts}\nown {i} end") for i in range(5)]
    rows += [(10, f"alone {short}"), (11, None), (12, ""), (13, "\n\n"), (14, passage), (14, passage), (15, f"x\n{parts}")]
    df = spark.createDataFrame([(*r, "keep", 3, "c") for r in rows], "doc_id long, text string, removed string, n_lines int, cut string")
    out = {}
    for r in linededup.dedup(df).collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert out[0] == [rows[0][1]]
    for i in range(1, 5):
        assert out[i] == [f"{short}\nown {i} start\nown {i} middle\nown {i} end"]
    assert out[10] == [rows[5][1]] and out[11] == [None] and out[12] == [""] and out[13] == ["\n\n"]
    assert out[14] == ["", ""] and out[15] == ["x"]
    assert linededup.dedup(df.limit(0)).count() == 0


def test_line_dedup_of_long_and_repeating_texts(spark):
    line = " ".join(f"r{i}" for i in range(30))
    rows = [(1, "\n".join([line] * 3000)), (2, "\n".join(f"{i} " + line for i in range(3000)))]
    out = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == line and out[2] == rows[1][1]


def test_rows_of_one_id_with_other_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"a\n{passage}"), (1, f"b\n{passage}"), (None, passage)], "doc_id long, text string")
    texts = sorted(r.text for r in linededup.dedup(df).select(F.coalesce("text", F.lit("")).alias("text")).collect())
    assert texts == sorted(["a", "b", passage])


def test_words_of_a_line_equal_the_pattern(spark):
    from pyspark.sql import functions as F

    from shizuku.llm import linededup
    from shizuku.llm.common import WORD

    odd = ["", " ", "  ", "a", " a", "a ", " a ", "a b", "a  b", "a\tb", "\t", "a\rb c", "\x0b\x0c", "é ü ö", "a\x1cb c", "x. y! z?", "日本 語", "a b c  "]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    got = df.select("x", linededup._words(F.col("x")).alias("fast"), F.regexp_count("x", F.lit(WORD)).alias("slow")).collect()
    assert [r.x for r in got if r.fast != r.slow] == []
    # The pieces without a pattern are those of split_lines.
    texts = ["", "a. b! c? d.e", ". . ? ! x", "a.\n b. \n\n c", "a.  b", ".\n", " . "]
    for r in linededup.marked(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id int, th long, text string"), 1).collect():
        row = spark.createDataFrame([(texts[r.id],)], "t string").select(linededup.split_lines(F.col("t")).alias("l")).first()
        assert len(r.h) == len([x for x in row.l if x["text"].strip(" \t\x0b\x0c\r") != ""])
