"""Facts: every row once, with all reasons; and what a stage reads, told by its plan."""

import pytest
from pyspark.sql import functions as F

from shizuku.operators import facts
from shizuku.operators.facts import Reference
from shizuku.sources import tables


def test_references_and_reasons(spark):
    rows = spark.createDataFrame([(1, "a", 10, 1.0), (2, "b", 10, 2.0), (3, "x", 99, None), (4, None, None, 5.0), (4, None, None, 5.0), (5, "a", 99, -1.0)], "id int, place string, unit int, value double")
    places, units = spark.createDataFrame([("a", "A"), ("b", None), (None, "none")], "k string, name string"), spark.createDataFrame([(10, "mg"), (11, "g")], "u int, label string")
    found = facts.resolved(rows, [Reference("place", places, (("place", "k"),), (("name", "name"),)), Reference("unit", units, (("unit", "u"),), (("label", "label"),), False)], [("value", F.col("value") > 0)])
    got = sorted(((r.id, r.name, r.label, r.rejected) for r in found.collect()), key=str)
    assert got == [(1, "A", "mg", []), (2, None, "mg", []), (3, None, None, ["place", "value"]), (4, "none", None, []), (4, "none", None, []), (5, "A", None, ["value"])]
    assert facts.accepted(found).count() == 4 and {tuple(r) for r in facts.reasons(found).collect()} == {("place", 1), ("value", 2)}
    assert tuple(facts.conserved(rows, found).first()) == (6, 4, 2, True)
    none = rows.limit(0)
    assert tuple(facts.conserved(none, facts.resolved(none, [])).first()) == (0, 0, 0, False)
    with pytest.raises(Exception, match="place has several rows"):
        facts.resolved(rows, [Reference("place", places.union(places), (("place", "k"),), (("name", "name"),))]).collect()


def test_reading_past_the_catalog_is_refused(spark, tmp_path):
    catalog = tables.Catalog(spark, f"file://{tmp_path}/c")
    for name in ("a", "b"):
        catalog.verified[name] = tables.publish(spark.range(5), f"{catalog.path}/{name}")
    spark.range(3).write.parquet(f"{tmp_path}/other")
    outside = lambda: spark.read.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="past the catalog.*other"):
        catalog.build("x", lambda c: c.read("a").join(outside(), "id"))
    with pytest.raises(ValueError, match="past the catalog.*/b"):
        catalog.build("x", lambda c: c.read("a").union(spark.read.parquet(f"{catalog.path}/b")))
    outside().createOrReplaceTempView("outside_rows")
    with pytest.raises(ValueError, match="past the catalog"):
        catalog.build("x", lambda c: c.read("a").filter("id < (SELECT max(id) FROM outside_rows)"))
    catalog.build("y", lambda c: (c.read("b"), c.read("a").union(spark.range(2)))[1])
    assert list(catalog.lineage["y"]["from"]) == ["a"] and catalog.lineage["y"]["rows"] == 7  # b was opened, but isn't in the plan
    assert ("memory", "Range") in tables.leaves(spark.range(2)) and tables.leaves(outside())[0][0] == "files"
