"""WARC records, and the resolution of not-modified revisits.

A crawler that gets 304 for a page it knows writes a revisit record without a body. `resolve` gives each revisit the
latest earlier full response of its canonical URL by an as-of join, checks the validators that both carry (entity tag, else
time of last change, else payload digest), and merges the revisit's headers into the response's where RFC 9111 lets a 304
update them.

The as-of join goes through two levels, so that one URL with a third of all records doesn't land in one task: records of a URL are
dealt to slices of time, the last response of each slice is carried to the following slices, and within a slice a
window finds the latest. Bodies take no part; only digests and record ids move.

Defined cases: without an earlier response a revisit is `no_base`; a null or empty URL resolves nothing; validators that differ give
`validator_mismatch`, validators that are missing on one side `unvalidated`, both without a base; of records at the same time, responses come before revisits
and smaller record ids first; repeated records are resolved each for itself.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header fields that a 304 response doesn't change, because they describe the stored body or one connection.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade"]
# Query parameters that follow visitors and don't choose content.
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid)"
#: Slices of time that the records of one URL are dealt to.
SLICES = 128
#: One slice more for so many records, up to so many slices.
SLICE_ROWS, MOST_SLICES = 500_000, 1024


def canonical(url: Column) -> Column:
    """One form for URLs of the same content: no scheme, `www.`, default port, fragment, tracking parameters or slash at the end; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "(?:=|$)")))
    return F.when(F.trim(url) != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers (maps with lower-case names) with those of the 304, but for KEPT_FIELDS."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*KEPT_FIELDS))
    old = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(old, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with canonical_url, base_id, status, headers (merged) and payload_sha256, payload_length of the response they stand for.

    records: record_id, url, at (long), kind ('response' or 'revisit'), headers map<string,string>, payload_sha256, payload_length.
    """
    order_kind = F.when(F.col("kind") == "response", 0).otherwise(1)
    rows = records.withColumn("canonical_url", canonical(F.col("url"))).withColumn("__when", F.struct("at", order_kind.alias("k"), F.col("record_id").alias("id")))
    full = F.when(F.col("kind") == "response", F.struct(F.col("__when").alias("when"), F.col("record_id").alias("id"), "headers", "payload_sha256", "payload_length"))
    # Slices hold about as many records each, so one wrong time doesn't put all others into one slice; there are more where there are more records.
    n = max(SLICES, min(MOST_SLICES, records.count() // SLICE_ROWS))
    cuts = records.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    cuts = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array().cast("array<long>")
    rows = rows.withColumn("__slice", F.size(F.filter(cuts, lambda x: x <= F.col("at"))).cast("int")).withColumn("__full", full)
    # Level 1: the last response of each slice, carried on; at most a row a slice and URL.
    last = rows.filter("__full IS NOT NULL AND canonical_url IS NOT NULL").groupBy("canonical_url", "__slice").agg(F.max_by("__full", "__when").alias("__last"))
    asked = rows.filter("kind = 'revisit' AND canonical_url IS NOT NULL").select("canonical_url", "__slice").distinct()
    steps = asked.join(last, ["canonical_url", "__slice"], "full_outer")
    carried = F.last("__last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select(F.col("canonical_url").alias("__url"), F.col("__slice").alias("__s"), carried.alias("__carried"))
    # Level 2: within the slice.
    within = F.last("__full", ignorenulls=True).over(Window.partitionBy("canonical_url", "__slice").orderBy("__when").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.filter("canonical_url IS NOT NULL").withColumn("__base", within).filter("kind = 'revisit'")
    found = found.join(steps, (F.col("canonical_url") == F.col("__url")) & (F.col("__slice") == F.col("__s")), "left")
    found = found.withColumn("__base", F.coalesce("__base", "__carried")).drop("__url", "__s", "__carried")
    # Without a URL nothing can be found: these rows take no part in windows.
    none = rows.filter("canonical_url IS NULL AND kind = 'revisit'").withColumn("__base", F.lit(None).cast(found.schema["__base"].dataType))
    return checked(found.unionByName(none))


def checked(found: DataFrame) -> DataFrame:
    """Revisits with the struct __base, judged by their validators."""
    base = F.col("__base")
    fresh_tag, base_tag = F.regexp_replace(F.col("headers")["etag"], "^W/", ""), F.regexp_replace(base["headers"]["etag"], "^W/", "")
    fresh_time, base_time = F.col("headers")["last-modified"], base["headers"]["last-modified"]
    agrees = F.when(fresh_tag.isNotNull() & base_tag.isNotNull(), fresh_tag == base_tag)
    agrees = agrees.when(fresh_time.isNotNull() & base_time.isNotNull(), fresh_time == base_time)
    agrees = agrees.when(F.col("payload_sha256").isNotNull() & base["payload_sha256"].isNotNull(), F.col("payload_sha256") == base["payload_sha256"])
    status = F.when(base.isNull(), "no_base").when(agrees, "resolved").when(~agrees, "validator_mismatch").otherwise("unvalidated")
    ok = F.col("status") == "resolved"
    out = found.withColumn("status", status)
    return out.select(
        "record_id", "url", "canonical_url", "at", "status", F.when(ok, base["id"]).alias("base_id"),
        F.when(ok, merged_headers(base["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, base["payload_sha256"]).alias("payload_sha256"), F.when(ok, base["payload_length"]).alias("payload_length"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """resolved with the column payload of the responses (record_id, payload) that they stand for."""
    return resolved.join(responses.select(F.col("record_id").alias("base_id"), "payload"), "base_id", "left")


# Files of records.


def record_bytes(kind: str, record_id: str, url: str, date: str, status: str, headers: dict[str, str], payload: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record that holds an HTTP response, gzipped as a member of its own."""
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": url, "WARC-Date": date, **(extra or {}), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields with names in lower case; values of a field that repeats are joined by commas, continued lines by spaces."""
    out, name = {}, ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _head(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The lines from `at` up to an empty one, and the place behind it; -1 if there is none."""
    lines = []
    while (end := data.find(b"\n", at)) >= 0:
        line = data[at:end].rstrip(b"\r")
        at = end + 1
        if not line:
            return lines, at
        lines.append(line)
    return lines, -1


def _members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Contents of a file's gzip members, each with what is wrong with it; after a broken one the next one that begins is read."""
    at, magic, step = 0, b"\x1f\x8b\x08", 1 << 16
    while (at := data.find(magic, at)) >= 0:
        reader, out, start = zlib.decompressobj(31), [], at
        try:
            while not reader.eof and at < len(data):
                part = data[at : at + step]
                at += len(part)
                out.append(reader.decompress(part))
            at -= len(reader.unused_data)
            yield b"".join(out), None if reader.eof else "gzip member is cut off"
        except zlib.error:
            at = start + len(magic)
            yield b"".join(out), "gzip member is broken"


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        lines, body = _head(data, at)
        head = _fields(lines[1:])
        size = head.get("content-length", "0")
        problem = None
        if not lines or not lines[0].startswith(b"WARC/"):
            problem = "not a record"
        elif body < 0:
            problem = "header is cut off"
        elif not size.isascii() or not size.isdigit():
            problem = "content-length isn't a number"
        elif body + int(size) > len(data):
            problem = "record is cut off"
        found = {"record_id": head.get("warc-record-id", "").strip("<>"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": None, "headers": {}, "payload": None, "problem": problem}
        if problem:
            yield found
            next_ = data.find(b"\nWARC/", at)
            at = next_ + 1 if next_ >= 0 else len(data)
            continue
        block = data[body : body + int(size)]
        at = body + int(size)
        found["payload"] = block
        if head.get("content-type", "").startswith("application/http"):
            http, end = _head(block, 0)
            found |= {"status": http[0].decode("latin-1").partition(" ")[2] if http else None, "headers": _fields(http[1:]), "payload": block[end:] if end >= 0 else b""}
        yield found


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped by record, as a whole or not at all. What is wrong with a record stands in `problem`, and reading goes on at the next one."""
    if data[:2] != b"\x1f\x8b":
        yield from _records(data)
        return
    for content, problem in _members(data):
        for record in _records(content):
            yield record | {"problem": record["problem"] or problem}
        if problem and not content:
            yield {"record_id": "", "kind": None, "url": None, "date": None, "status": None, "headers": {}, "payload": None, "problem": problem}


SCHEMA = "record_id string, kind string, url string, date string, status string, headers map<string,string>, payload binary, problem string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path; a file is read in one task, its records one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                held = []
                for record in parse(content):
                    held.append(record)
                    if len(held) == 500:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


# A crawl of the `pages` table.


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl of `pages` (page_id, url, html): page i is fetched in full at time i and asked for again half the crawl later, while other fetches go on.

    Responses carry an entity tag, a time of change and a digest, all of them made of the content. Of every four revisits one
    carries the tag, one the time, one the digest and one none. A page whose canonical URL was fetched with other content before its
    revisit doesn't agree with the latest response; one that is fetched again after it doesn't matter.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", F.sha2(body, 256).alias("sha"), F.length(body).cast("long").alias("bytes"))
    tag, changed = F.concat(F.lit('"'), F.substring("sha", 1, 16), F.lit('"')), F.substring("sha", 17, 16)
    made = lambda fields: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values())), lambda k, v: v.isNotNull())
    responses = base.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "url", F.col("page_id").alias("at"), F.lit("response").alias("kind"),
        made({"etag": tag, "last-modified": changed, "content-type": F.lit("text/html"), "content-length": F.col("bytes").cast("string"), "date": F.col("page_id").cast("string"), "cache-control": F.lit("max-age=60")}).alias("headers"),
        F.col("sha").alias("payload_sha256"), F.col("bytes").alias("payload_length"),
    )
    later = F.col("page_id") + F.lit((pages.agg(F.max("page_id")).first()[0] or 0) // 2)
    which = F.pmod(F.col("page_id"), F.lit(4))
    revisits = base.select(
        F.concat(F.lit("v"), "page_id").alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"),
        made({"etag": F.when(which == 0, tag), "last-modified": F.when(which == 1, changed), "date": later.cast("string"), "content-length": F.lit("0"), "expires": F.lit("never")}).alias("headers"),
        F.when(which == 2, F.col("sha")).alias("payload_sha256"), F.lit(None).cast("long").alias("payload_length"),
    )
    return responses.unionByName(revisits)
