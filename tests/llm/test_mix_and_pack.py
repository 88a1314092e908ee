import zlib

import duckdb
import numpy as np
import pytest

from shizuku.llm import mixing, packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def water_fill(sizes):
    """The rule as stated: share by weight, stop at three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and free:
        total, left_now = sum(weight[s] for s in free), left
        left = 0.0
        for s in list(free):
            target[s] += left_now * weight[s] / total
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_targets_follow_the_rule(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, 8) ** 2 // 300)} | {None: int(rng.integers(1, 50))}
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = water_fill(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in sizes)


def test_mix_on_odd_rows(spark):
    rows = [(1, "a b c", "x", 0), (1, "a b c", "x", 0), (2, None, "x", 0), (3, "", None, 0), (4, "w " * 400, None, 0), (5, "one", "y", 0), (None, "two words", "y", 0), (6, " \t\n", "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    assert all(r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies for r in out)
    assert {r["size"] for r in out if r.doc_id == 1} == {3} and sum(r["size"] for r in out) == 409
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mix(df).collect()) == sorted((str(r.doc_id), r.taken) for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mix_equals_its_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(db.execute(queries.OP5_SQL).fetchall())
    got = sorted(tuple(r) for r in queries.op5_weighted_mix(spark, d).collect())
    assert got == want
    by = {}
    for _, _, size, target, taken in got:
        by.setdefault((size, target), []).append(taken)
    assert sum(map(sum, by.values())) <= 1.02 * sum(r[1] for r in got)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "it's DON'T we'll", "naïve café STRASSE ß µ ªº x² ½", "İstanbul ΑΣ σς", "a<|endoftext|>b <|startoftext|>", "中文 mixed テキスト 한국어", "a\x1cb\x85c​d﻿e", "é ́x", "12345 3.14 a_b--c !!!", "\x00\x07 bell", "🙂🙃 emoji", "ﬁ ﬂ ligatures", "x" * 3000]


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(PATH)
    assert encoder.merge is not None
    texts = ODD + [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for text, want in zip(texts, whole_ids(texts), strict=True):
        assert encoder.ids(text).tolist() == want, text[:80]


def verify(rows, capacity):
    by, docs = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_packing_is_whole_and_tight(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op6_best_fit_pack(spark, d).collect()
    by = verify(rows, 4096)
    texts = {r[0]: r[1] or "" for r in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()}
    ids = dict(zip(texts, whole_ids(list(texts.values())), strict=True))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(texts)
    for key, pieces in got.items():
        full = np.array([*ids[key], 1], "<u4")
        at = 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(full[at : at + r.length].tobytes()))
            assert r.length == min(4096, len(full) - at)
            at += r.length
        assert at == len(full)
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 5), (3, "word " * 9000, 5), (4, "one", 5)], "doc_id long, text string, length int")
    rows = packing.pack(df, PATH).collect()
    verify(rows, 4096)
    assert sorted((r.doc_id, r.length) for r in rows if r.doc_id != 3) == [(1, 1), (1, 1), (2, 1), (4, 2)]
    assert sum(r.length for r in rows if r.doc_id == 3) == 9001
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_configurations_cover_every_piece():
    rng = np.random.default_rng(2)
    for capacity, pool in ((50, rng.integers(1, 51, 400)), (50, np.full(90, 26)), (50, rng.integers(1, 4, 700)), (50, np.array([50, 50, 1]))):
        histogram = np.bincount(pool, minlength=capacity + 1)
        total = np.zeros(capacity + 1, int)
        sequences = 0
        for times, counts in packing.configurations(histogram, capacity):
            sequences += times
            assert sum(k * n for k, n in counts.items()) <= capacity
            for k, n in counts.items():
                total[k] += n * times
        assert (total == histogram).all()
        bins = []
        for x in sorted(pool.tolist(), reverse=True):
            room = [i for i, b in enumerate(bins) if b + x <= capacity]
            if room:
                bins[max(room, key=lambda i: bins[i])] += x
            else:
                bins.append(x)
        assert sequences <= len(bins) + 1

