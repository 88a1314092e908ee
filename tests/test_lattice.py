"""Stored roll-ups: every level that can answer gives the direct answer, and a refresh rolls up what has changed, no more."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shizuku import registered
from shizuku.operators import lattice, observation_cube
from shizuku.operators.lattice import Level
from shizuku.plans import domain, stored_cells
from shizuku.sources import parted
from shizuku.sources.stored import scratch_dir

FACT = "region_id string, place_id string, place_kind string, variable_id string, obs_stat string, unit_id string, value_grain string, period_grain string, period_start string, period_end string, censoring string, censoring_limit double, value_num double"


def facts_of(spark, seed=1, extra=()):
    draw = random.Random(seed)
    rows = []
    for _ in range(600):
        day = f"{draw.randrange(2018, 2022)}-{draw.randrange(1, 13):02d}-{draw.randrange(1, 29):02d}"
        value = draw.choice([None, 0.1, 0.2, 0.3, 1 / 3, 7.0, -2.5])
        kind = draw.choice(["none", "none", "below_lod", "not_detected"])
        rows.append(("r", f"p{draw.randrange(5)}", "site", draw.choice("ab"), draw.choice([None, "mean"]), draw.choice(["u", "v"]), "day", "day", day, day, kind, 0.5 if kind == "below_lod" else None, value if kind == "none" else None))
    return spark.createDataFrame(rows + list(extra), FACT)


def zones_of(spark):
    return spark.createDataFrame([(f"p{i}", i % 2) for i in range(4)], "place_id string, zone_id int")  # p4 has none


MEASURES = {"n": ("total", "n"), "cells": ("count",), "mean": ("mean", "vz_mean"), "low": ("min", "vl_mean"), "high": ("max", "vz_sum"), "total": ("sum", "vl_sum")}
REQUESTS = [
    (["variable_id"], MEASURES, None, []), (["variable_id", "month_of_year"], MEASURES, None, []), (["zone_id", "year"], MEASURES, "zone_id IS NOT NULL", []), (["place_id"], {**MEASURES, "v": ("distinct", "variable_id"), "a": ("first",), "z": ("last",)}, "unit_id = 'u'", ["unit_id"]),
    (["variable_id"], {"p": ("distinct", "place_id"), "y": ("distinct", "year")}, None, []), (["variable_id"], {"p": ("distinct", "place_id")}, None, []), (["year", "obs_stat"], MEASURES, "month_of_year IN ('01', '07')", ["month_of_year"]), (["period_start"], MEASURES, "variable_id = 'a'", ["variable_id"]),
]


def direct(cells, keys, measures, where):
    rows = cells.withColumns({"year": F.substring("period_start", 1, 4), "month_of_year": F.substring("period_start", 6, 2)})
    rows = rows.filter(where) if where else rows
    exact = lambda v: F.sum(F.round(v, 9).cast("decimal(38,9)")).cast("double")
    kinds = {"total": lambda c: F.sum(c), "count": lambda: F.count("*"), "mean": lambda v: exact(v) / F.count(v), "sum": exact, "min": lambda v: F.min(v), "max": lambda v: F.max(v), "distinct": lambda k: F.countDistinct(k), "first": lambda: F.min("period_start"), "last": lambda: F.max("period_start")}
    return rows.groupBy(*keys).agg(*(kinds[m[0]](*m[1:]).alias(a) for a, m in measures.items()))


@pytest.fixture(scope="module")
def levels(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('levels')}"
    done = stored_cells.refreshed(spark, path, facts_of(spark), zones_of(spark), "one")
    assert done["day"] == ["2018", "2019", "2020", "2021"] and done["place"] == ["all"]
    return path, *stored_cells._lattices(spark, path)


@pytest.mark.parametrize("k", range(len(REQUESTS)))
def test_every_able_level_gives_the_direct_answer(levels, k):
    keys, measures, where, uses = REQUESTS[k]
    _, days, _ = levels
    want = sorted(map(tuple, direct(days.cells(), keys, measures, where).collect()), key=str)
    able = days.able(keys, measures, uses)
    assert want and able[-1] is stored_cells.DAY and [days.table(x.name).rows() for x in able] == sorted(days.table(x.name).rows() for x in able)
    for level in able:
        assert sorted(map(tuple, days.answer(keys, measures, where, uses, level).collect()), key=str) == want, level.name


@pytest.mark.parametrize("k", range(len(REQUESTS)))
def test_facts_answer_as_levels_do(spark, levels, k):
    keys, measures, where, uses = REQUESTS[k]
    _, days, _ = levels
    own = stored_cells.unstored(facts_of(spark), zones_of(spark))[0]
    assert own.able(keys, measures, uses) == [stored_cells.DAY]
    want = sorted(map(tuple, days.answer(keys, measures, where, uses).collect()), key=str)
    assert want and sorted(map(tuple, own.answer(keys, measures, where, uses).collect()), key=str) == want
    if "zone_id" not in keys:
        assert sorted(map(tuple, stored_cells.unstored(facts_of(spark))[0].answer(keys, measures, where, uses).collect()), key=str) == want


def test_levels_from_facts_are_those_stored(spark, levels):
    _, days, years = levels
    own, own_years = stored_cells.unstored(facts_of(spark), zones_of(spark))
    pairs = [(own.level(x.name), days.level(x.name)) for x in stored_cells.LEVELS] + [(own.cells(), days.cells()), (own_years.cells(), years.cells())]
    for made, there in pairs:
        there = there.select(made.columns)
        assert there.count() > 0 and made.exceptAll(there).count() == there.exceptAll(made).count() == 0, made.columns
    with pytest.raises(StopIteration):
        stored_cells.unstored(facts_of(spark))[0].level("zone_month")


#: Queries over daily cells and levels: by the facts, where none are stored, and by the stored ones.
BOTH = ["cell_invariants", "cells_of_spec", "climatology", "obs_daily", "obs_month_from_day", "series_summary", "site_variables", "thinned_series", "variable_catalog_by_region", "water_bodies", "year_series_pivot", "zone_year"]


@pytest.fixture(scope="module")
def tables_apart(spark, sf_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for t in ("lineitem", "supplier", "nation"):
        (at / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    rows = lambda: {n: sorted(map(str, registered.QUERIES[n](spark, str(at)).collect())) for n in BOTH}
    place = Path(scratch_dir(spark).removeprefix("file://")) / "shizuku-cubes"
    before = set(place.glob("observation-*"))
    alone = rows()
    made = set(place.glob("observation-*")) - before
    stored_cells.observation_levels(spark, str(at))
    assert stored_cells.levels(spark, str(at))[0].made is None
    return alone, made, rows()


@pytest.mark.parametrize("name", BOTH)
def test_queries_by_facts_and_by_stored_levels(tables_apart, name):
    alone, made, stored = tables_apart
    assert alone[name] == stored[name] and not made


def test_cells_by_the_tables_keys(spark, tmp_path):
    """Null and odd keys, several items in a cell: the same cells as by the texts."""
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, 0), (2, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    draw, days = random.Random(3), [None, "1995-01-31 23:30:00", "1995-02-01 00:00:00", "1996-12-31 12:00:00"]
    items = [(draw.choice([1, 2, 3, None]), draw.choice([None, -1, 0, 1, 2, 3, 4, 5, 6]), draw.choice([1.0, 5.0, 7.25, None]), draw.choice([0.0, 0.04]), draw.choice(["N", "R", None]), draw.choice("OF"), draw.choice(days)) for _ in range(500)]
    rows = spark.createDataFrame(items, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, d string")
    rows.withColumn("l_shipdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{at}/lineitem.parquet")
    texts = observation_cube.day_stats(observation_cube.imputed(domain.observation(spark, at)))
    own = domain.day_cells(spark, at).select(texts.columns)
    assert own.count() == texts.count() > 50 and own.exceptAll(texts).count() == texts.exceptAll(own).count() == 0


def test_the_smallest_level_is_taken(levels):
    _, days, years = levels
    first = lambda keys, measures, uses=(): days.able(keys, measures, uses)[0].name
    assert first(["variable_id"], {"p": ("distinct", "place_id")}) == "variable" and first(["variable_id", "month_of_year"], {"n": ("count",)}) in ("zone_month", "series_month")
    assert first(["place_id"], {"n": ("count",)}) == "place" and first(["place_id"], {"n": ("count",)}, ["year"]) == "year" and first(["period_start"], {"n": ("count",)}) == "day"
    assert years.able(["zone_id", "year", "variable_id"], {"n": ("distinct", "place_id")})[0].name == "zone_year"
    with pytest.raises(ValueError, match="no level"):
        days.answer(["colour"], {"n": ("count",)})
    with pytest.raises(ValueError, match="doesn't hold"):
        days.answer(["place_id"], {"n": ("count",)}, level=stored_cells.LEVELS[3])


def test_refresh_rolls_up_changed_years_only(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    facts, zones = facts_of(spark, 2), zones_of(spark)
    stored_cells.refreshed(spark, path, facts, zones, "one")
    assert not any(stored_cells.refreshed(spark, path, facts, zones, "one").values())
    late = ("r", "p9", "site", "a", None, "u", "day", "day", "2020-05-05", "2020-05-05", "none", None, 4.0)
    more = facts_of(spark, 2, [late])
    days = stored_cells._lattices(spark, path)[0]
    old = {v: p["folder"] for v, p in days.table("month").manifest()["parts"].items()}
    asked = []
    done = stored_cells.refreshed(spark, path, more, zones, "one")
    assert done["day"] == done["month"] == done["year"] == done["zone_month"] == done["year_mean"] == done["zone_year"] == ["2020"] and done["place"] == done["variable"] == ["all"], asked
    days, years = stored_cells._lattices(spark, path)
    new = {v: p["folder"] for v, p in days.table("month").manifest()["parts"].items()}
    assert {v for v in new if new[v] != old[v]} == {"2020"}
    whole = f"file://{tmp_path}/w"
    stored_cells.refreshed(spark, whole, more, zones, "one")
    for again, fresh in zip((days, years), stored_cells._lattices(spark, whole), strict=True):
        for level in (again.base, *again.levels):
            a, b = again.table(level.name).read(), fresh.table(level.name).read()
            assert a.exceptAll(b.select(a.columns)).count() == b.select(a.columns).exceptAll(a).count() == 0, level.name
    gone = stored_cells.refreshed(spark, path, facts.filter("period_start >= '2020'"), zones, "one")
    assert gone["day"] == ["2020"] and set(stored_cells._lattices(spark, path)[0].table("day").manifest()["parts"]) == {"2020", "2021"}
    assert stored_cells.refreshed(spark, path, facts, zones, "another definition")["day"] == ["2018", "2019", "2020", "2021"]
    none = stored_cells.refreshed(spark, path, facts.limit(0), zones, "one")
    assert none["day"] == [] and stored_cells._lattices(spark, path)[0].answer(["variable_id"], {"n": ("count",)}).count() == 0


def test_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b"), (2, "c d"), (3, None), (4, "c d")], "k int, g string")
    store = parted.Parted(spark, f"file://{tmp_path}/t")
    marks = parted.marks_of(rows, F.col("g"))
    pick = lambda values: rows.filter(F.coalesce("g", F.lit(parted.NONE)).isin(values))
    assert store.replace(pick, "g", marks) == sorted(["a/b", "c d", parted.NONE])
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and store.rows() == 4
    assert [r.k for r in store.read(lambda v: v == "a/b").collect()] == [1]
    kept = parted.Parted(spark, store.path)
    with pytest.raises(RuntimeError):
        kept.replace(lambda v: (_ for _ in ()).throw(RuntimeError("lost")), "g", {**marks, "c d": "other"})
    with pytest.raises(ValueError, match="weren't asked for"):
        kept.replace(lambda v: rows, "g", {**marks, "c d": "other"})
    assert parted.Parted(spark, store.path).read().count() == 4
    # A part without rows is known all the same; folders go one change after they were retired.
    assert kept.replace(lambda v: rows.limit(0), "g", {**marks, "c d": "empty"}) == ["c d"] and kept.changed({**marks, "c d": "empty"}) == []
    assert sorted(r.k for r in kept.read().collect()) == [1, 3] and len(kept.manifest()["retired"]) == 1
    old = tmp_path / "t" / kept.manifest()["retired"][0]
    assert old.exists()
    kept.replace(pick, "g", {parted.NONE: marks[parted.NONE]})
    assert not old.exists() and [r.k for r in parted.Parted(spark, store.path).read().collect()] == [3]


def test_levels_count_dropped_keys(spark, tmp_path):
    own = lattice.Lattice(spark, f"file://{tmp_path}/x", Level("base", ("a", "b", "year")), (Level("top", ("a",), ("b",)),), ("v",), ("n",))
    rows = spark.createDataFrame([("x", "p", "1", 1.0, 1), ("x", "q", "1", None, 2), ("y", "p", "2", 3.0, 3), (None, None, "2", 4.0, 4)], "a string, b string, year string, v double, n long")
    own.refresh(lambda parts: rows.filter(F.col("year").isin(parts)), parted.marks_of(rows, F.col("year")), "s")
    got = own.answer(["a"], {"d": ("distinct", "b"), "m": ("mean", "v"), "n": ("total", "n")})
    assert own.able(["a"], {"d": ("distinct", "b")})[0].name == "top" and {tuple(r) for r in got.collect()} == {("x", 2, 1.0, 3), ("y", 1, 3.0, 3), (None, 0, 4.0, 4)}


def test_series_are_summed_in_one_pass(spark, sf_dir):
    """The facts are read once, and folded by series and place: no daily cells come in between."""
    plan = registered.QUERIES["series_summary"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and "l_shipdate" not in plan.split("Relation [l_orderkey")[0]


def test_cells_of_a_specification_choose_their_facts_first(spark, sf_dir):
    """Places and series are met before the facts are folded into daily cells."""
    plan = registered.QUERIES["cells_of_spec"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    folded = max(i for i, line in enumerate(plan.splitlines()) if "avg(v_zero" in line)
    assert plan.count("LeftSemi") == 2 and all(i > folded for i, line in enumerate(plan.splitlines()) if "LeftSemi" in line)


def test_cells_are_folded_once_where_they_are_dealt(spark, sf_dir):
    """Line items go through one shuffle by the tables' keys; what the check doesn't count isn't computed."""
    from shizuku.plans.observation_queries import days_of

    plan = registered.QUERIES["cell_invariants"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_suppkey" in plan and "site:" not in plan and "sum(v_zero" not in plan
    assert days_of(spark, sf_dir).count() == domain.day_cells(spark, sf_dir).count()
