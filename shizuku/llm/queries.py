"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shizuku.llm import alignment, decontaminate, divergence, fingerprint, html_main, langid, linededup, mixing, neardup, packing, quality, topk, warc
from shizuku.llm.common import crc_of, read


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", html_main.extract_column(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", k=20)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out), "text", "lang", "doc_id")
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all pages, fetched and revisited while the crawl goes on: which response each revisit stands for."""
    out = warc.resolve(warc.crawl(read(spark, sf_dir, "pages")))
    number = F.substring("record_id", 2, 20).cast("long").alias("page_id")
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(number, "url", "canonical_url", "status", F.substring("base_id", 2, 20).cast("long").alias("base_page_id"), headers.alias("headers"), "payload_sha256", "payload_length")


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read(spark, sf_dir, "documents")))


def op6_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited(read(spark, sf_dir, "documents"))
    fp, changed, following = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.text_of(fp).alias("fingerprint"), fingerprint.text_of(changed).alias("edited_fingerprint"),
        fingerprint.likeness(fp, changed).alias("near_edited"), fingerprint.likeness(fp, following).alias("near_next"),
    )


def op8_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    known = labels.filter(~held_out & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    # Labels cover some documents only; the fit itself takes a bounded number of them.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(quality.MOST)
    model = quality.train(docs.join(F.broadcast(chosen), "doc_id"), "text", "quality", "doc_id")
    out = quality.rank(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, read(spark, sf_dir, "benchmark")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.digest(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_ALL = (op1_html_main_text, op2_exact_top_k, op3_language_id, op4_warc_revisits, op5_weighted_mix, op6_best_fit_pack, op7_multiset_fingerprint, op8_quality_rank, op9_line_dedup, op10_near_duplicates, op11_decontaminate, op12_source_divergence, op13_tokenizer_alignment)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


# Every page of the table has one article element, without parts that go: there the main text is its text.
OP1_SQL = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br[^>]*>', ' ', 'g') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1|h2|div)\b[^>]*>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '</?(?:b|i|em|a|span)\b[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP5_SQL = r"""WITH r AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
b AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b),
l AS (SELECT *, (budget - stopped) / (weights - used) AS level FROM p),
c AS (SELECT level AS common FROM l WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, budget, least(cap, coalesce((SELECT common FROM c) * weight, cap)) AS target FROM l),
u AS (SELECT r.*, t.source_size, t.budget, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER () AS rid FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
k AS (SELECT u.*, upto + g.k * source_size AS fin, (upto + g.k * source_size) / target AS finish FROM u, (SELECT unnest([0, 1, 2]) AS k) g
  WHERE size > 0 AND target > 0 AND (upto + g.k * source_size) - size / 2.0 <= target),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS turn FROM k),
n AS (SELECT rid, count(*) AS copies FROM q WHERE turn < budget GROUP BY rid)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken FROM u LEFT JOIN n USING (rid)
"""


OP9_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS li FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL)),
a AS (SELECT rid, doc_id, li, unnest(ps) AS part, unnest(range(len(ps))) AS pi FROM (SELECT *, string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ps FROM s)),
w AS (SELECT rid, doc_id, li, part, row_number() OVER (PARTITION BY rid ORDER BY li, pi) - 1 AS i, CAST(len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) AS INTEGER) AS words,
  substr(md5(part), 1, 15) AS d, CAST('0x' || substr(md5(part), 1, 15) AS BIGINT) AS h FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS place, sum(words) OVER (PARTITION BY rid ORDER BY i) AS upto, count(*) OVER (PARTITION BY rid) AS n FROM w WHERE words > 0),
e AS (SELECT x.rid, x.doc_id, x.place, min(y.place) FILTER (y.upto - x.upto + x.words >= 25) AS e1 FROM f x JOIN f y ON y.rid = x.rid AND y.place BETWEEN x.place AND x.place + 25 GROUP BY x.rid, x.doc_id, x.place),
v AS (SELECT *, max(place) OVER (PARTITION BY rid) AS last_start FROM e WHERE e1 IS NOT NULL),
m AS (SELECT v.rid, least(min({'d': f.d, 'i': f.place}).i, any_value(last_start)) AS i FROM v JOIN f ON f.rid = v.rid AND f.place BETWEEN v.place AND v.e1 GROUP BY v.rid, v.place),
p AS (SELECT DISTINCT m.rid, v.doc_id, m.i, CAST('0x' || substr(md5((SELECT string_agg(y.d, '' ORDER BY y.place) FROM f y WHERE y.rid = m.rid AND y.place BETWEEN m.i AND v.e1)), 1, 15) AS BIGINT) AS g
  FROM (SELECT DISTINCT * FROM m) m JOIN v ON v.rid = m.rid AND v.place = m.i),
o AS (SELECT *, lag(i) OVER (PARTITION BY rid, g ORDER BY i) AS last_i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, i) AS nth, first_value(rid) OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, i) AS rid0,
  first_value(i) OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, i) AS i0 FROM p),
t AS (SELECT DISTINCT rid, CASE WHEN last_i IS NULL THEN rid0 ELSE rid END AS rid0, CASE WHEN last_i IS NULL THEN i - i0 ELSE i - last_i END AS shift FROM o WHERE last_i IS NOT NULL OR rid0 <> rid),
q AS (SELECT t.rid, t.rid0, t.shift, x.place, x.words, x.place - row_number() OVER (PARTITION BY t.rid, t.rid0, t.shift ORDER BY x.place) AS run
  FROM t JOIN f x ON x.rid = t.rid JOIN f y ON y.rid = t.rid0 AND y.place = x.place - t.shift AND y.h = x.h),
r AS (SELECT rid, min(place) AS lo, max(place) AS hi FROM q GROUP BY rid, rid0, shift, run HAVING sum(words) >= 25),
x AS (SELECT DISTINCT f.rid, f.place FROM r JOIN f ON f.rid = r.rid AND f.place BETWEEN lo AND hi),
l AS (SELECT w.*, max(f.place) OVER (PARTITION BY w.rid ORDER BY w.i) AS at FROM w LEFT JOIN f ON f.rid = w.rid AND f.i = w.i),
k AS (SELECT l.*, x.place IS NOT NULL AS gone FROM l LEFT JOIN x ON x.rid = l.rid AND x.place = l.at),
j AS (SELECT rid, string_agg(CASE WHEN last_li IS NULL THEN '' WHEN last_li = li THEN ' ' ELSE chr(10) END || part, '' ORDER BY i) AS kept
  FROM (SELECT *, lag(li) OVER (PARTITION BY rid ORDER BY i) AS last_li FROM k WHERE NOT gone) GROUP BY rid),
c AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS removed_lines FROM k GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(removed_lines, 0) AS INTEGER) AS removed_lines, CAST(CASE WHEN text IS NOT NULL THEN length(coalesce(kept, '')) END AS BIGINT) AS kept_chars,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM d LEFT JOIN c USING (rid) LEFT JOIN j USING (rid)
"""

OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, least(doc_id, min(other)) AS least_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least_id, w.doc_id) AS component_id, coalesce(c.least_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""


OP4_SQL = r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS sha, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid)(?:=|$)'))) AS kept FROM p),
c AS (SELECT page_id, url, sha, bytes, page_id + (SELECT max(page_id) // 2 FROM pages) AS later, CASE WHEN trim(url) <> '' THEN regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(?:80|443)$', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url FROM q),
b AS (SELECT v.page_id AS v_id, max(r.page_id) AS base FROM c v JOIN c r ON r.canonical_url = v.canonical_url AND r.page_id <= v.later GROUP BY v.page_id),
j AS (SELECT c.*, base, r.sha AS base_sha, r.bytes AS base_bytes, CASE WHEN base IS NULL THEN 'no_base' WHEN c.page_id % 4 = 3 THEN 'unvalidated'
    WHEN CASE c.page_id % 4 WHEN 0 THEN substr(c.sha, 1, 16) = substr(r.sha, 1, 16) WHEN 1 THEN substr(c.sha, 17, 16) = substr(r.sha, 17, 16) ELSE c.sha = r.sha END THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM c LEFT JOIN b ON v_id = c.page_id LEFT JOIN c r ON r.page_id = base)
SELECT page_id, url, canonical_url, status, CASE WHEN status = 'resolved' THEN base END AS base_page_id,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=60;content-length=' || base_bytes || ';content-type=text/html;date=' || later || ';etag="' || substr(base_sha, 1, 16) || '";expires=never;last-modified=' || substr(base_sha, 17, 16)
    ELSE 'content-length=0;date=' || later || CASE WHEN page_id % 4 = 0 THEN ';etag="' || substr(sha, 1, 16) || '"' ELSE '' END || ';expires=never' || CASE WHEN page_id % 4 = 1 THEN ';last-modified=' || substr(sha, 17, 16) ELSE '' END END AS headers,
  CASE WHEN status = 'resolved' THEN base_sha END AS payload_sha256, CASE WHEN status = 'resolved' THEN base_bytes END AS payload_length
FROM j
"""


# A window is an item's ten words in a row, or all its words where it has fewer.
OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS gram FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS k FROM i WHERE len(ws) > 0)),
p AS (SELECT rid, n, array_to_string(ws[k:k + n - 1], ' ') AS gram, k FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
h AS (SELECT rid, p.n, k, item FROM p JOIN g USING (n, gram)),
c AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS w FROM (SELECT DISTINCT rid, n, k FROM h)) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

# The definition itself: every group with every kept term of its language.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
a AS (SELECT g.lang, g.source, l.term, l.n AS all_n, coalesce(c.n, 0) AS n FROM g JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
s AS (SELECT lang, source, sum(n) AS n FROM a GROUP BY lang, source),
p AS (SELECT a.lang, a.source, a.term, a.n, 1 + (CAST(1000000000 AS HUGEINT) * (a.n + 1)) // (s.n + v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (a.all_n + 1)) // (v.n + v.v) AS q
  FROM a JOIN s ON s.lang = a.lang AND s.source = a.source JOIN v ON v.lang = a.lang),
e AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(e.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN e ON e.lang = x.lang AND e.source = x.source AND e.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_decontaminate": OP11_SQL, "op12_source_divergence": OP12_SQL, "op1_html_main_text": OP1_SQL, "op10_near_duplicates": OP10_SQL, "op2_exact_top_k": OP2_SQL, "op4_warc_revisits": OP4_SQL, "op5_weighted_mix": OP5_SQL, "op9_line_dedup": OP9_SQL}
