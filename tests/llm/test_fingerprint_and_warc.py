import gzip
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shizuku.llm import fingerprint as fp
from shizuku.llm import queries, warc


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.f for r in df.select("i", fp.text_of(fp.lanes(F.col("t"))).alias("f")).orderBy("i").collect()]


def test_equal_multisets_have_equal_fingerprints(spark):
    a, b, c, d, e, n = prints(spark, ["x\ny\nz", "z\nx\ny", "x\ny", "x\nx\ny", "", None])
    assert a == b and e == n and len({a, c, d, e}) == 4
    assert len({len(x) for x in (a, c, e)}) == 1


def test_insert_and_delete(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(20):
        base, more = [f"p{rng.randrange(50)}" for _ in range(rng.randrange(1, 300))], [f"p{rng.randrange(50)}" for _ in range(rng.randrange(1, 300))]
        rows.append(("\n".join(base), "\n".join(more), "\n".join(more + base)))
    df = spark.createDataFrame(rows, "a string, b string, both string").select(*(fp.lanes(F.col(c)).alias(c) for c in ("a", "b", "both")))
    out = df.select((fp.combined(F.col("a"), F.col("b")) == F.col("both")).alias("plus"), (fp.combined(F.col("both"), F.col("b"), -1) == F.col("a")).alias("minus")).collect()
    assert all(r.plus and r.minus for r in out)


def test_lanes_wrap_around(spark):
    n = (1 << 20) + 5
    df = spark.range(1).select(F.repeat(F.lit("x\n"), n - 1).alias("t"))
    wrapped = df.select(fp.lanes(F.concat("t", F.lit("x"))).alias("f")).first().f
    five = spark.range(1).select(fp.lanes(F.lit("\n".join("xxxxx"))).alias("f")).first().f
    assert wrapped[0] == n and wrapped[1:] == five[1:]


def edited_of(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    return sorted(out)


def test_query_on_documents(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = queries.op7_multiset_fingerprint(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == edited_of(rows)
    texts = {i: t for i, t in rows}
    by = {}
    for r in got:
        by.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by.values())
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_neighbours_of_odd_rows(spark):
    rows = [(5, "abcdef"), (-3, "🙂🙃x"), (10**15, "last text"), (7, None), (7, "seven"), (None, "none"), (8, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next string")
    got = fp.edited(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == edited_of(rows)
    one = fp.edited(df.filter("doc_id = 5")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"abcabc").hexdigest())]
    assert fp.edited(df.limit(0)).count() == 0


def test_likeness(spark):
    same, half, none = "\n".join(f"p{i}" for i in range(200)), "\n".join(f"p{i}" for i in range(100, 300)), "\n".join(f"z{i}" for i in range(200))
    df = spark.createDataFrame([(same, same), (same, half), (same, none), ("", ""), ("", same)], "a string, b string")
    got = [r.x for r in df.select(fp.likeness(fp.lanes(F.col("a")), fp.lanes(F.col("b"))).alias("x")).collect()]
    assert got[0] == 1.0 and 0.3 < got[1] < 0.7 and got[2] < 0.25 and got[3] == 1.0 and got[4] < 0.3


SCHEMA = "record_id string, url string, at long, kind string, headers map<string,string>, payload_sha256 string, payload_length long"


def test_revisits_take_the_latest_earlier_response(spark):
    r = lambda i, url, at, tag, sha, **h: (i, url, at, "response", {"etag": tag, **h} if tag else h, sha, 10)
    v = lambda i, url, at, sha=None, **h: (i, url, at, "revisit", h, sha, None)
    rows = [
        r("r1", "http://www.A.com/x/?b=1&a=2&utm_source=q#f", 1, '"1"', "s1", **{"content-length": "10", "date": "1"}), r("r2", "https://a.com:443/x?a=2&b=1", 5, 'W/"2"', "s2", **{"content-length": "10"}),
        v("v0", "a.com/x?a=2&b=1", 0, etag='"1"'), v("v1", "http://a.com/x/?a=2&b=1", 3, etag='"1"', date="3", **{"content-length": "0"}), v("v2", "http://a.com/x?b=1&a=2", 5, etag='"2"'), v("v3", "http://a.com/x?b=1&a=2", 9, etag='"1"'),
        v("v4", "http://a.com/x?b=1&a=2", 9), v("v5", None, 9, etag='"1"'), v("v6", "", 9), r("r7", "http://b.com", 2, None, "s7", **{"last-modified": "m"}), v("v7", "http://b.com/", 4, **{"last-modified": "m"}), v("v8", "http://b.com/", 4, sha="s7"), v("v8", "http://b.com/", 4, sha="s7"),
    ]
    out = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((x.record_id, x.status, x.base_id) for x in out)
    assert got == [("v0", "no_base", None), ("v1", "resolved", "r1"), ("v2", "resolved", "r2"), ("v3", "validator_mismatch", None), ("v4", "unvalidated", None), ("v5", "no_base", None), ("v6", "no_base", None), ("v7", "resolved", "r7"), ("v8", "resolved", "r7"), ("v8", "resolved", "r7")]
    merged = next(x for x in out if x.record_id == "v1")
    assert merged.headers == {"etag": '"1"', "date": "3", "content-length": "10"} and merged.payload_sha256 == "s1"
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_revisits_match_brute_force(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for i in range(600):
        at += rng.randrange(0, 3)
        url, tag = f"http://h/{rng.randrange(3) if i % 3 else 0}", f'"{rng.randrange(3)}"'
        rows.append((f"{i:04d}", url, at, "response" if rng.random() < 0.2 else "revisit", {"etag": tag}, f"s{i}", 1))
    want = []
    for i, url, t, kind, h, *_ in rows:
        if kind == "revisit":
            base = max((x for x in rows if x[3] == "response" and x[1] == url and x[2] <= t), key=lambda x: (x[2], x[0]), default=None)
            want.append((i, "no_base" if base is None else "resolved" if base[4] == h else "validator_mismatch", base[0] if base and base[4] == h else None))
    got = sorted((x.record_id, x.status, x.base_id) for x in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(want)


def test_records_round_trip(spark, tmp_path):
    payloads = [b"", b"hello", bytes(range(256)) * 50, "é\r\n\r\n".encode()]
    data = b"".join(warc.record_bytes("response", f"urn:{i}", f"http://h/{i}", "2024-01-01T00:00:00Z", "200 OK", {"ETag": f'"{i}"', "Content-Type": "text/html"}, p) for i, p in enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(data) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut off")
    out = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert len(out) == 9 and [r.problem for r in out if r.problem] == ["record is cut off"]
    out = [r for r in out if r.problem is None]
    assert sorted((r.record_id, bytes(r.payload), r.headers["etag"], r.status) for r in out) == sorted((f"urn:{i}", p, f'"{i}"', "200 OK") for i, p in enumerate(payloads) for _ in range(2))
    assert list(warc.parse(b"")) == [] and [r["problem"] for r in warc.parse(b"junk")] == ["not a record"]


def test_reading_goes_on_after_bad_records():
    good = [warc.record_bytes("response", f"urn:{i}", "http://h/", "2024-01-01T00:00:00Z", "200 OK", {"A": "1", "B": "2"}, b"x" * i) for i in range(3)]
    plain = [gzip.decompress(x) for x in good]
    bad = plain[0].replace(b"Content-Length: ", b"Content-Length: x", 1)
    got = [(r["record_id"], r["problem"]) for r in warc.parse(plain[0] + bad + plain[1] + plain[2].replace(b"Content-Length: ", b"Content-Length: 9", 1) + plain[2])]
    assert got == [("urn:0", None), ("urn:0", "content-length isn't a number"), ("urn:1", None), ("urn:2", "record is cut off"), ("urn:2", None)]
    broken = bytearray(good[1])
    broken[20:40] = b"\xff" * 20
    ids = [(r["record_id"], r["problem"]) for r in warc.parse(good[0] + bytes(broken) + good[2] + good[1][:-12])]
    assert ids[0] == ("urn:0", None) and ("urn:2", None) in ids and sum(p is not None for _, p in ids) >= 2
    repeated = b"WARC/1.1\r\nWARC-Type: response\r\nX: a\r\nX: b\r\nContent-Type: application/http\r\nContent-Length: 43\r\n\r\nHTTP/1.1 200 OK\r\nVia: a\r\n more\r\nVia: b\r\n\r\nz"
    assert [(r["headers"], r["payload"]) for r in warc.parse(repeated)] == [({"via": "a more, b"}, b"z")]


def test_one_wrong_time_and_responses_after_the_revisit(spark):
    rows = [(f"r{i}", "http://h/", i, "response", {"etag": f'"{i}"'}, f"s{i}", 1) for i in range(0, 400, 2)] + [(f"v{i}", "http://h/", i, "revisit", {"etag": f'"{i - 1}"'}, None, None) for i in range(1, 400, 2)]
    out = warc.resolve(spark.createDataFrame([*rows, ("r", "http://h/", 10**15, "response", {}, "s", 1)], SCHEMA)).collect()
    assert {(x.record_id, x.base_id) for x in out} == {(f"v{i}", f"r{i - 1}") for i in range(1, 400, 2)}


def test_neighbours_of_ids_far_apart_and_of_texts(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(10**17, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = fp.with_next(df, "doc_id", ["text"])
    assert {(r.doc_id, r.next.text) for r in near.collect()} == {(i, f"text {i + 1}" if i < 299 else "far") for i in range(300)} | {(10**17, "text 0")}
    named = spark.createDataFrame([(f"id{i:04d}", f"text {i}") for i in range(200)] + [("", "none"), ("ä", "last")], "doc_id string, text string")
    got = {r.doc_id: r.next.text for r in fp.with_next(named, "doc_id", ["text"]).collect()}
    assert got == {f"id{i:04d}": f"text {i + 1}" if i < 199 else "last" for i in range(200)} | {"": "text 0", "ä": "none"}


def test_text_ids_with_a_long_common_beginning_spread_over_tasks(spark):
    ids = [f"document-of-the-corpus-{i:08d}" for i in range(20_000)]
    rows = spark.range(0, 20_000, numPartitions=4).select(F.format_string("document-of-the-corpus-%08d", "id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(None, "none"), (None, "none")], "doc_id string, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = fp.with_next(rows, "doc_id", ["text"])
        tasks = near.select("doc_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        got = near.select("doc_id", "next.text").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 20_002 and max(tasks) < 10_000
    assert {r.doc_id: r.text for r in got if r.doc_id} == {x: str(i + 1) if i < 19_999 else "none" for i, x in enumerate(ids)}
    assert sorted(r.text for r in got if r.doc_id is None) == ["0", "none"]


@pytest.mark.parametrize("column", ["fingerprint", "edited_fingerprint"])
def test_query_fingerprints_by_brute_force(spark, sf_dir, column):
    """Fingerprints and likenesses of the query, lane by lane, from the paragraphs' own sums."""
    got = queries.op7_multiset_fingerprint(spark, sf_dir).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall())
    ids = sorted(texts)
    follow = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    edit = lambda i: texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[follow[i]][: len(texts[i]) // 2]
    wanted = {i: texts[i] if column == "fingerprint" else edit(i) for i in ids}
    parts = sorted({x for t in wanted.values() for x in re.split(r"\n|(?<=[.!?]) ", t)})
    hashed = {r.p: [r[f"h{i}"] for i in range(fp.HASHES)] for r in spark.createDataFrame([(x,) for x in parts], "p string").select("p", *(F.xxhash64(F.lit(i), "p").alias(f"h{i}") for i in range(fp.HASHES))).collect()}
    lanes = {}
    for i, t in wanted.items():
        ps = re.split(r"\n|(?<=[.!?]) ", t)
        bits = np.array([[(h >> b) & 1 for h in hashed[p] for b in range(63)] for p in ps]).sum(0) % (1 << fp.BITS)
        longs = [sum(int(bits[h * 63 + k + 21 * lane]) << 21 * lane for lane in range(3)) for h in range(fp.HASHES) for k in range(21)]
        lanes[i] = (len(ps), longs)
    assert {r.doc_id: r[column] for r in got} == {i: "".join(f"{x:016x}" for x in [n, *longs]) for i, (n, longs) in lanes.items()}
    if column == "fingerprint":
        signs = {i: np.array([2 * (x >> 21 * lane & (1 << fp.BITS) - 1) - n for x in longs for lane in range(3)], float) for i, (n, longs) in lanes.items()}
        for r in got:
            a, b = signs[r.doc_id], signs[follow[r.doc_id]]
            want = 1.0 if lanes[r.doc_id] == lanes[follow[r.doc_id]] else max(0.0, a @ b / max(1e-300, np.sqrt((a @ a) * (b @ b))))
            assert r.near_next == pytest.approx(want, abs=1e-9)


def test_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    rel = db.execute(queries.OP4_SQL)
    names = [x[0] for x in rel.description]
    want = sorted(map(str, rel.fetchall()))
    got = sorted(str(tuple(r[n] for n in names)) for r in queries.op4_warc_revisits(spark, sf_dir).collect())
    assert got == want


def test_revisits_without_urls_and_more_slices(spark, monkeypatch):
    rows = [(f"r{i}", "http://h/", i, "response", {"etag": f'"{i}"'}, f"s{i}", 1) for i in range(0, 200, 2)] + [(f"v{i}", "http://h/", i, "revisit", {"etag": f'"{i - 1}"'}, None, None) for i in range(1, 200, 2)]
    rows += [(f"n{i}", None, i, "revisit", {}, None, None) for i in range(50)] + [("e", "  ", 5, "revisit", {}, None, None), ("q", None, 5, "response", {}, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(f"v{i}", f"r{i - 1}", "resolved") for i in range(1, 200, 2)} | {(f"n{i}", None, "no_base") for i in range(50)} | {("e", None, "no_base")}
    assert {(x.record_id, x.base_id, x.status) for x in warc.resolve(df).collect()} == want
    monkeypatch.setattr(warc, "SLICE_ROWS", 1)
    assert {(x.record_id, x.base_id, x.status) for x in warc.resolve(df).collect()} == want
