"""Adapters, stored tables, upserts, thinning and archives: what the registered queries don't show."""

import pytest
from pyspark.sql import functions as F

from shizuku.functions import naming
from shizuku.operators import checks, flow, registry, series
from shizuku.sources import adapters, files, stored, tables


def test_stored_tables_are_built_once_for_each_state(spark, tmp_path):
    path, built = f"file://{tmp_path}/t", []

    def table():
        rows = spark.read.parquet(path)

        def build():
            built.append(rows.inputFiles())
            return rows.groupBy("k").count()

        return stored.stored("counts", [rows], build, sort_by=("k",))

    spark.createDataFrame([(1,), (1,), (2,)], "k int").write.parquet(path)
    assert sorted(map(tuple, table().collect())) == [(1, 2), (2, 1)]
    first = stored.state_of([spark.read.parquet(path)])
    assert sorted(map(tuple, table().collect())) == [(1, 2), (2, 1)] and stored.state_of([spark.read.parquet(path)]) == first
    spark.createDataFrame([(3,)], "k int").write.mode("overwrite").parquet(path)
    assert sorted(map(tuple, table().collect())) == [(3, 1)] and stored.state_of([spark.read.parquet(path)]) != first


def test_publish_keeps_the_old_table_when_a_check_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.publish(spark.range(3), path)

    def bad(df):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        tables.publish(spark.range(5), path, [bad])
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert tables.publish(spark.range(0), path)["rows"] == 0 and spark.read.parquet(path).count() == 0


def test_upsert_of_null_keys_and_repeated_rows(spark):
    kind = "k int, v string, at int"
    old = spark.createDataFrame([(1, "a", 0), (None, "b", 0)], kind)
    new = spark.createDataFrame([(1, "x", 2), (1, "z", 1), (None, "c", 5), (None, "d", 4), (2, "e", 1)], kind)
    replaced = {tuple(r)[:2] for r in registry.upsert(old, new, ["k"], order=["at"]).collect()}
    assert replaced == {(1, "x"), (None, "c"), (2, "e")}
    assert {tuple(r)[:2] for r in registry.upsert(old, new, ["k"], "ignore", ["at"]).collect()} == {(1, "a"), (None, "b"), (2, "e")}
    assert registry.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_flow_of_empty_tables_and_cycles(spark):
    assignments = spark.createDataFrame([("z", "f", 1.0, "high", None, None), ("y", "g", 1.0, "low", None, None)], "zone string, facility_id string, share double, confidence string, valid_from string, valid_to string")
    edges = spark.createDataFrame([("f", "m", 0.5, "measured", None, None), ("m", "s", 1.0, "estimated", None, None), ("f", "f2", 0.5, "measured", None, None), ("f2", "f", 1.0, "measured", None, None), ("g", "s", None, "unknown", None, None)], "to_id string, from_id string, share double, basis string, valid_from string, valid_to string")
    sources = spark.createDataFrame([("s",)], "source_id string")
    shares, lost = flow.compose(assignments, edges, sources, "2024-01-01")
    assert sorted(map(tuple, shares.collect())) == [("y", "s", None, "low", "unknown"), ("z", "s", 0.5, "high", "estimated")]
    assert [tuple(r) for r in lost.collect()] == [("z", 0.5)]
    for a, e in ((assignments.limit(0), edges), (assignments.limit(0), edges.limit(0))):
        shares, lost = flow.compose(a, e, sources, "2024-01-01")
        assert shares.count() == 0 and lost.count() == 0
    shares, lost = flow.compose(assignments, edges.limit(0), sources, "2024-01-01")
    assert shares.count() == 0 and {r.zone for r in lost.collect()} == {"z", "y"}


def test_flow_beyond_depth_and_through_braids(spark):
    kind = "to_id string, from_id string, share double, basis string, valid_from string, valid_to string"
    sources = spark.createDataFrame([("s",)], "source_id string")
    zone = spark.createDataFrame([("z", "n0", 1.0, "high", None, None)], "zone string, facility_id string, share double, confidence string, valid_from string, valid_to string")
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0, "measured", None, None) for i in range(4)] + [("n4", "s", 1.0, "measured", None, None)], kind)
    for depth, (shares, unresolved) in {2: (0, 1), 3: (0, 1), 4: (1, 0), 32: (1, 0)}.items():
        rows, lost = flow.compose(zone, chain, sources, "2024-01-01", depth)
        assert (rows.count(), lost.count()) == (shares, unresolved), depth
    # Fourteen diamonds in a row: 16,384 paths, one row a step and node.
    arms = [(f"n{i}", f"{side}{i}", 0.5, "measured", None, None) for i in range(14) for side in "ab"] + [(f"{side}{i}", f"n{i + 1}", 1.0, "derived", None, None) for i in range(14) for side in "ab"]
    rows, lost = flow.compose(zone, spark.createDataFrame([*arms, ("n14", "s", 0.75, "measured", None, None), ("n14", "gone", 0.25, "measured", None, None)], kind), sources, "2024-01-01")
    assert [tuple(r) for r in rows.collect()] == [("z", "s", 0.75, "high", "derived")] and [tuple(r) for r in lost.collect()] == [("z", 0.25)]
    # A cycle beside a way out: what comes back to a node is unresolved, the rest flows on.
    ring = [("n0", "n1", 1.0, "measured", None, None), ("n1", "n0", 0.25, "measured", None, None), ("n1", "s", 0.75, "measured", None, None)]
    rows, lost = flow.compose(zone, spark.createDataFrame(ring, kind), sources, "2024-01-01")
    assert [r.share for r in rows.collect()] == [0.75] and [r.unresolved for r in lost.collect()] == [0.25]


def test_thinning(spark):
    rows = spark.range(0, 1000, numPartitions=7).withColumn("extra", F.lit("x"))
    assert [r.id for r in series.evenly(rows, ["id"], 3).orderBy("id").collect()] == [0, 500, 999]
    assert series.evenly(rows.limit(0), ["id"], 3).count() == 0 and series.evenly(rows, ["id"], 0).count() == 0 and series.evenly(rows, ["id"], 1).count() == 1


def test_manifests_and_adapters(spark):
    assert adapters.Manifest("", "r", "a int", True).problems() == ["source is empty", "expected_rows isn't a number of rows"]
    with pytest.raises(ValueError, match="source is empty"):
        adapters.adapted(spark.range(1), adapters.Manifest("", "r", "a int"), "def rows(c): return []")
    good = adapters.Manifest("s", "r", "a long, b string", 2, (("positive", "a > 0"),))
    rows = spark.createDataFrame([(1, None), (None, "x"), (3, "y")], "n int, t string")

    doubled = "def rows(context):\n    for row in context.input_rows():\n        if row['n'] is not None:\n            yield {'a': 2 * int(row['n']), 'b': row['t']}\n"
    out = adapters.adapted(rows, good, doubled)
    assert sorted(map(tuple, out.collect())) == [(2, None, "s", "r"), (6, "y", "s", "r")]
    assert adapters.unmet(out, good).count() == 0
    assert {tuple(r) for r in adapters.unmet(out, adapters.Manifest("s", "r", "a long", 3, (("big", "a > 5"), ("absent", "b = 'y'")))).collect()} == {("rows", 3, 2), ("big", 0, 1), ("absent", 0, 1)}
    assert adapters.adapted(rows.limit(0), good, doubled).count() == 0
    with pytest.raises(ValueError, match="boundary.*import of os"):
        adapters.adapted(rows, good, "import os\n" + doubled)
    with pytest.raises(ValueError, match="no function rows"):
        adapters.adapted(rows, good, "x = 1")


LEAVING = [
    "import os", "from pathlib import Path", "import re, sqlite3", "from . import sibling", "from .re import match", "from re import *", "from re import _compiler", "import json.decoder", "import importlib", "import builtins",
    "open('f')", "f = open", "x = __import__('os')", "eval('1')", "exec('1')", "compile('1', '', 'eval')", "x = getattr(1, 'real')", "setattr(1, 'a', 2)", "globals()", "locals()", "vars()", "input()", "breakpoint()", "dir()", "type(1)", "object()",
    "__builtins__['op' + 'en']('x')", "x = __builtins__", "import re\ny = re.__dict__", "().__class__.__bases__[0].__subclasses__()", "import re\nx = re.__loader__", "'{0.__class__}'.format(1)", "'{x.__class__}'.format_map({})",
    "def g():\n    yield 1\nx = g().gi_frame.f_back", "try:\n    1 / 0\nexcept ZeroDivisionError as e:\n    x = e.__traceback__", "match 1:\n    case int(__class__=c):\n        pass", "class A:\n    pass", "def rows(c):\n    def inner():\n        return lambda: open('f')\n    return inner", "x = (",
]


@pytest.mark.parametrize("code", LEAVING)
def test_code_beyond_the_boundary_is_refused_before_it_runs(code):
    assert adapters.refusals(code), code
    with pytest.raises(ValueError, match="boundary"):
        adapters.loaded(f"{code}\ndef rows(c):\n    return []\n")


def test_code_within_the_boundary_runs(spark):
    code = "from __future__ import annotations\nimport re, json, math\nimport datetime as d\nfrom decimal import Decimal\nfrom collections import defaultdict\n\nSEEN = defaultdict(int)\n\ndef clean(x: str) -> str:\n    return re.sub(r'\\s+', ' ', x).strip()\n\ndef rows(context):\n    global LAST\n    for row in context.input_rows():\n        try:\n            n = int(Decimal(row['n']))\n        except (ValueError, ArithmeticError, TypeError):\n            continue\n        SEEN[n] += 1\n        LAST = json.dumps({'n': n, 'up': math.floor(n + 0.5)}, sort_keys=True)\n        yield {'a': n, 'b': f\"{clean(row['t'])} {LAST} {d.date(2020, 1, n % 28 + 1).isoformat()}\"}\n"
    assert adapters.refusals(code) == []
    rows = spark.createDataFrame([("3", " a  b "), ("x", "c"), (None, "d")], "n string, t string")
    assert [tuple(r) for r in adapters.adapted(rows, adapters.Manifest("s", "r", "a long, b string"), code).collect()] == [(3, 'a b {"n": 3, "up": 3} 2020-01-04', "s", "r")]
    # At run time too only served names are there: what reading the code could miss fails.
    assert "open" not in adapters._GIVEN and "type" not in adapters._GIVEN
    with pytest.raises(ImportError):
        adapters._served("os")
    assert not hasattr(adapters._served("collections"), "abc") and not hasattr(adapters._served("re"), "enum")


def test_data_source(spark, tmp_path):
    adapters.register(spark)
    data = spark.range(0, 4000, numPartitions=1).selectExpr("id AS k", "CAST(id % 7 AS STRING) AS t", "id * 2 AS unread")
    data.write.option("parquet.block.size", 4096).option("parquet.page.row.count.limit", 100).parquet(f"{tmp_path}/raw")
    parquet = [f for f in spark.read.parquet(f"{tmp_path}/raw").inputFiles()]
    (tmp_path / "more.jsonl").write_text('{"k": 9001, "t": "5", "unread": 1}\n\n{"k": 9002}\n')
    (tmp_path / "more.csv").write_text("k,t,unread\n9100,5,0\n9101,6,0\n")
    code = "def rows(context):\n    for row in context.input_rows():\n        if 'unread' in row:\n            raise ValueError('read too much')\n        yield {'key': row['k'], 'five': str(row['t']) == '5'}\n"
    manifest = adapters.Manifest("s", "r", "key long, five boolean", code=code, inputs=(*parquet, str(tmp_path / "more.jsonl"), f"file://{tmp_path}/more.csv"), columns=("k", "t"), copied=(("key", "k"),))
    assert adapters.Manifest.from_json(manifest.to_json()) == manifest
    place = tmp_path / "m.json"
    place.write_text(manifest.to_json())
    read = lambda: spark.read.format("shizuku_adapter").option("manifest", str(place)).load()
    assert read().schema.simpleString() == "struct<key:bigint,five:boolean,source_id:string,region_id:string>"
    assert (read().count(), read().filter("five").count()) == (4004, 571 + 2)
    assert sorted(r.key for r in read().filter("key >= 3998").collect()) == [3998, 3999, 9001, 9002, 9100, 9101]
    assert read().filter("source_id = 'other'").count() == 0 and read().filter("source_id = 's' AND key IN (5, 9001)").count() == 2
    reader = adapters.AdapterReader(manifest, read().schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([GreaterThan(("key",), 10**6)])) and len(reader.partitions()) == 2  # no row group can hold it; the other files have no statistics
    reader = adapters.AdapterReader(manifest, read().schema)
    assert list(reader.pushFilters([EqualTo(("region_id",), "elsewhere")])) and reader.partitions() == []
    place.write_text(adapters.Manifest("s", "r", "key long", code="import os\n" + code, inputs=tuple(parquet)).to_json())
    with pytest.raises(Exception, match="import of os"):
        read().count()
    with pytest.raises(ValueError, match="no"):
        adapters.Manifest.from_json('{"source": "s", "colour": 1}')


@pytest.mark.parametrize(("text", "kind"), [("CC0-1.0", "open"), ("cc_by 4.0", "open"), ("CC BY-NC-SA 3.0", "noncommercial"), ("http://creativecommons.org/publicdomain/zero/1.0/", "open"), ("", "unknown"), (None, "unknown"), ("byline", "unknown"), ("All Rights Reserved", "unknown"), ("cc-by-sa", "restricted"), ("CC BY-ND 4.0", "restricted"), ("https://creativecommons.org/licenses/by-sa/4.0/legalcode", "restricted"), ("http://creativecommons.org/licenses/by/4.0/legalcode", "open"), ("http://creativecommons.org/licenses/by-nc-sa/4.0/legalcode", "noncommercial"), ("cc-by-nc-nd", "noncommercial"), ("cc-by", "open")])
def test_licenses(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(naming.license_class(F.col("t"))).first()[0] == kind


def test_cells_of_wrong_shape(spark):
    kind = "grain string, period_start string, period_end string"
    rows = [("year", "1999-01-01", "1999-12-31"), ("year", "1999-01-02", "1999-12-31"), ("survey_period", "1999-01-01", "1999-12-31"), ("month", "2000-02-01", "2000-02-29"), ("month", "2000-02-01", "2000-02-28"), ("week", "a", "b")]
    assert tuple(checks.misshapen_cells(spark.createDataFrame(rows, kind), ["year", "month", "survey_period"]).first()) == (1, 1, 1, 1)


def test_archive_with_a_missing_event(spark, tmp_path):
    kind = "occurrenceID string, eventID string, basisOfRecord string, scientificName string, occurrenceStatus string, license string, eventDate string, locationID string, samplingProtocol string"
    records = spark.createDataFrame([("o1", "e1", "b", "Aa\tbb\n", "present", "CC0", "d", "l", "p"), ("o2", "e2", "b", "Cc", "present", "CC0", "d", None, "p")], kind)
    archive = files.darwin_core(records, ["CC0"])
    archive["event"] = archive["event"].filter("eventID = 'e1'")
    files.write_darwin_core(archive, f"file://{tmp_path}/a")
    back = files.read_darwin_core(spark, f"file://{tmp_path}/a")
    assert {r.scientificName for r in back["occurrence"].collect()} == {"Aa bb", "Cc"} and back["event"].count() == 1
    assert [tuple(r) for r in files.orphans(back).collect()] == [("occurrence", "e2")]


def test_nearest_at_poles_and_across_the_date_line(spark):
    import math
    import random

    from shizuku.operators import spatial

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1.0)))

    rng = random.Random(3)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), rng.uniform(-90, -87), 0.0]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)]))
    points, places = [spot() for _ in range(200)], [spot() for _ in range(60)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "point_id long, lat double, lon double")
    to = spark.createDataFrame([(f"p{i:02d}", *x) for i, x in enumerate(places)], "place_id string, lat double, lon double")
    for reach in (80.0, 400.0):
        want = {}
        for i, x in enumerate(points):
            d, j = min((km(x, y), f"p{j:02d}") for j, y in enumerate(places))
            if d <= reach:
                want[i] = j
        got = {r.point_id: r.place_id for r in spatial.nearest(df, to, reach).collect()}
        assert got == want and want
