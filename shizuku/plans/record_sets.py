"""The fifteen record sets over the driver's tables, and queries that read all of them from their declarations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shizuku.operators import records
from shizuku.operators.records import Lookup, RecordSet
from shizuku.plans.domain import query, table

_NATION = Lookup("nation", "n_nationkey", "s_nationkey", {"nation": "n_name", "region_id": "n_regionkey"})
SETS = {
    "regions": RecordSet("region", "region_id", {"region_id": "r_regionkey", "name": "r_name"}, ("name",)),
    "zones": RecordSet("nation", "zone_id", {"zone_id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"}, ("name",), source="region_id", lookups=(Lookup("region", "r_regionkey", "n_regionkey", {"region": "r_name"}),)),
    "sites": RecordSet("supplier", "site_id", {"site_id": "s_suppkey", "name": "s_name", "zone_id": "s_nationkey", "balance": "s_acctbal"}, ("name",), ("balance",), "zone_id", lookups=(_NATION, Lookup("lineitem", "l_suppkey", "s_suppkey", {"n_values": "count(*)", "last_value": "max(l_shipdate)"}, True)), extra={"title": "concat(name, ', ', nation)"}),
    "observers": RecordSet("customer", "observer_id", {"observer_id": "c_custkey", "name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal", "zone_id": "c_nationkey"}, ("name", "segment"), ("balance",), "segment", lookups=(Lookup("nation", "n_nationkey", "c_nationkey", {"nation": "n_name"}), Lookup("orders", "o_custkey", "c_custkey", {"n_surveys": "count(*)"}, True))),
    "taxa": RecordSet("part", "taxon_id", {"taxon_id": "p_partkey", "name": "p_name", "group": "p_type", "brand": "p_brand", "size": "p_size"}, ("name", "group"), ("size",), "brand"),
    "surveys": RecordSet("orders", "survey_id", {"survey_id": "o_orderkey", "status": "o_orderstatus", "date": "o_orderdate", "priority": "o_orderpriority", "price": "o_totalprice"}, ("priority",), ("price",), "priority", lookups=(Lookup("customer", "c_custkey", "o_custkey", {"observer": "c_name"}),)),
    "values": RecordSet("lineitem", "value_id", {"value_id": "l_orderkey * 10 + l_linenumber", "site_id": "l_suppkey", "taxon_id": "l_partkey", "quantity": "l_quantity", "date": "l_shipdate", "flag": "l_returnflag"}, (), ("quantity",), "flag"),
    "open_values": RecordSet("lineitem", "value_id", {"value_id": "l_orderkey * 10 + l_linenumber", "quantity": "l_quantity", "flag": "l_returnflag"}, (), ("quantity",), "flag", where="l_linestatus = 'O'"),
    "sensor_readings": RecordSet("events", "reading_id", {"reading_id": "event_id", "sensor": "user_id", "kind": "event_type", "at": "ts", "value": "value"}, ("kind",), ("value",), "kind"),
    "documents": RecordSet("documents", "doc_id", {"doc_id": "doc_id", "lang": "lang", "origin": "source", "n_chars": "n_chars", "opening": "substring(text, 1, 80)"}, ("opening",), ("n_chars",), lookups=(Lookup("labels", "doc_id", "doc_id", {"quality": "max(quality)", "toxic": "max(toxic)"}, True),)),
    "sourced_documents": RecordSet("documents", "doc_id", {"doc_id": "doc_id", "sources": "concat(source, '|', lang)", "n_chars": "n_chars"}, (), ("n_chars",), "sources", True),
    "assessments": RecordSet("labels", "doc_id", {"doc_id": "doc_id", "quality": "quality", "toxic": "toxic"}, (), ("quality",)),
    "pages": RecordSet("pages", "page_id", {"page_id": "page_id", "url": "url", "size": "length(html)", "html": "html"}, ("url",), ("size",), geometry="html"),
    "questions": RecordSet("benchmark", "item_id", {"item_id": "item_id", "text": "text"}, ("text",)),
    "turns": RecordSet("conversations", "turn_id", {"turn_id": "conv_id * 1000 + turn", "conv_id": "conv_id", "role": "role", "text": "text"}, ("text",), ("conv_id",), "role"),
}


def tables_of(spark, sf_dir):
    return lambda name: table(spark, sf_dir, name)


_COUNTS = {
    "regions": "region", "zones": "nation", "sites": "supplier", "observers": "customer", "taxa": "part", "surveys": "orders", "values": "lineitem", "open_values": "lineitem WHERE l_linestatus = 'O'", "sensor_readings": "events",
    "documents": "documents", "sourced_documents": "documents", "assessments": "labels", "pages": "pages", "questions": "benchmark", "turns": "conversations",
}
_KEYS = {"regions": "r_regionkey", "zones": "n_nationkey", "sites": "s_suppkey", "observers": "c_custkey", "taxa": "p_partkey", "surveys": "o_orderkey", "values": "l_orderkey * 10 + l_linenumber", "open_values": "l_orderkey * 10 + l_linenumber", "sensor_readings": "event_id", "documents": "doc_id", "sourced_documents": "doc_id", "assessments": "doc_id", "pages": "page_id", "questions": "item_id", "turns": "conv_id * 1000 + turn"}
_COLUMNS = {name: len(x.known()) - bool(x.geometry) for name, x in SETS.items()}


@query(" UNION ALL ".join(f"SELECT '{name}' AS record_set, {_COLUMNS[name]} AS n_columns, count(*) AS n, CAST(min({_KEYS[name]}) AS BIGINT) AS first_id, CAST(max({_KEYS[name]}) AS BIGINT) AS last_id FROM {of}" for name, of in _COUNTS.items()))
def record_sets(spark, sf_dir):
    """Every record set, all columns and lookups, over its whole table."""
    parts = []
    for name, declared in SETS.items():
        rows = records.read(tables_of(spark, sf_dir), declared, limit=None, any_source=True)
        parts.append(rows.agg(F.count("*").alias("n"), F.min(declared.pk).cast("long").alias("first_id"), F.max(declared.pk).cast("long").alias("last_id")).select(F.lit(name).alias("record_set"), F.lit(len(rows.columns)).alias("n_columns"), "n", "first_id", "last_id"))
    return reduce(DataFrame.unionByName, parts)


@query("WITH v AS (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS last_value FROM lineitem GROUP BY ALL) SELECT s_suppkey AS site_id, s_name || ', ' || n_name AS title, n AS n_values, strftime(last_value, '%Y-%m-%d') AS last_day FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN v ON l_suppkey = s_suppkey WHERE s_acctbal BETWEEN -500 AND 8000 AND lower(s_name) LIKE '%supplier%'")
def records_with_lookups(spark, sf_dir):
    """Sites with columns of two lookups, one of them folded by site, and a column over both tables."""
    rows = records.read(tables_of(spark, sf_dir), SETS["sites"], ["site_id", "title", "n_values", "last_value"], between={"balance": (-500, 8000)}, text="Supplier", any_source=True, limit=None)
    return rows.select("site_id", "title", "n_values", F.date_format("last_value", "yyyy-MM-dd").alias("last_day"))


@query("SELECT doc_id, quality, n_chars FROM (SELECT d.doc_id, d.n_chars, (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS quality, source || '|' || lang AS sources FROM documents d) WHERE quality = 1 AND n_chars BETWEEN 100 AND 100000 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 40 OFFSET 20")
def records_page(spark, sf_dir):
    """A page of a list sorted by a column, tested by one of a lookup."""
    return records.read(tables_of(spark, sf_dir), SETS["documents"], ["doc_id", "quality", "n_chars"], equal={"quality": 1}, between={"n_chars": (100, 100_000)}, order=[("n_chars", True)], limit=40, offset=20)


@query("SELECT source || '|' || lang AS sources, count(*) AS n FROM documents WHERE source || '|' || lang IS NOT NULL AND (source = 'src1' OR lang = 'src1') GROUP BY ALL")
def records_of_source(spark, sf_dir):
    """Records one of whose several sources is asked for: whole names between bars, so src1 isn't src10."""
    return records.read(tables_of(spark, sf_dir), SETS["sourced_documents"], ["sources"], source="src1", limit=None).groupBy("sources").agg(F.count("*").alias("n"))
