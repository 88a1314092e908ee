import pytest
from pyspark.sql import functions as F

from shizuku.operators import checks, occurrence_cube, sampling, series, summary
from shizuku.operators import observation_cube as cube

OBS = "region_id string, place_id string, place_kind string, variable_id string, obs_stat string, unit_id string, value_grain string, period_grain string, period_start string, period_end string, censoring string, censoring_limit double, value_num double"


def obs(*rows):
    out = []
    for place, variable, stat, grains, start, end, kind, limit, value in rows:
        out.append(("r", place, "site", variable, stat, None, *grains, start, end, kind, limit, value))
    return out


def day(place, d, kind, value=None, limit=None, variable="v", stat=None, grain="day"):
    return (place, variable, stat, ("day", grain), d, d, kind, limit, value)


@pytest.fixture(scope="module")
def facts(spark):
    rows = obs(
        day("a", "2024-01-01", "none", 2.0), day("a", "2024-01-01", "below_lod", None, 0.5), day("a", "2024-01-02", "not_detected"), day("a", "2024-01-03", "not_detected"), day("a", "2024-02-01", "none", 8.0), day("a", "2024-02-02", "above_lod", None, 9.0),
        day("a", "2024-03-01T10:00:00", "none", 1.0, grain="hour"), day("a", "2024-03-01T11:00:00", "none", 3.0, grain="hour"), day("b", "2024-01-01", "none", -5.0, variable="rain", stat="sum"), day("b", "2024-01-01", "none", 7.0, variable="rain", stat="max"),
        ("b", "v", None, ("day", "month"), "2024-01-01", "2024-01-31", "none", None, 4.0), ("b", "v", None, ("day", "month"), "2024-03-01", "2024-03-31", "none", None, 6.0), ("b", "v", None, ("day", "month"), "2024-04-01", "2024-04-30", "none", None, 10.0), ("b", "v", None, ("month", "month"), "2024-04-01", "2024-04-30", "none", None, 99.0),
        ("b", "v", None, ("year", "year"), "2024-01-01", "2024-12-31", "none", None, 1.5),
    )
    return spark.createDataFrame(rows, OBS).cache()


@pytest.fixture(scope="module")
def built(spark, facts):
    variables = spark.createDataFrame([("rain", "sum"), ("v", "mean")], "variable_id string, default_stat string")
    return cube.cube(facts, variables).cache()


def cell(built, **want):
    rows = built
    for k, v in want.items():
        rows = rows.filter(F.col(k).eqNullSafe(F.lit(v)))
    found = rows.collect()
    assert len(found) == 1, found
    return found[0]


def test_daily_cells_of_censored_values(built):
    c = cell(built, place_id="a", grain="day", stat="mean", period_start="2024-01-01")
    assert (c.value_zero, c.value_lod, c.n, c.n_censored, c.n_not_detected) == (1.0, 1.25, 2, 1, 0)
    c = cell(built, place_id="a", grain="day", stat="max", period_start="2024-01-02")
    assert (c.value_zero, c.value_lod, c.n, c.n_not_detected) == (None, None, 1, 1)
    assert built.filter("place_id = 'a' AND grain = 'day' AND period_start = '2024-02-02'").count() == 0


def test_months_and_years_rest_on_daily_means(built):
    c = cell(built, place_id="a", grain="month", input_grain="day", period_start="2024-01-01")
    assert (c.value_zero, c.n, c.n_not_detected, c.period_end) == (1.0, 3, 2, "2024-01-31")
    c = cell(built, place_id="a", grain="year", input_grain="day", stat="max")
    assert (c.value_zero, c.n) == (8.0, 4)
    assert cell(built, place_id="a", grain="month", input_grain="hour").value_zero == 2.0


def test_sums_only_where_they_mean_something(built):
    sums = built.filter("stat = 'sum'").collect()
    assert [(r.variable_id, r.obs_stat, r.value_zero) for r in sums] == [("rain", "sum", -5.0)]


def test_fiscal_years_of_restored_months(built):
    rows = {r.period_start: r for r in built.filter("grain = 'fiscal_year' AND stat = 'mean'").collect()}
    assert {k: (v.value_zero, v.n, v.period_end) for k, v in rows.items()} == {"2023-04-01": (5.0, 2, "2024-03-31"), "2024-04-01": (10.0, 1, "2025-03-31")}
    assert cell(built, grain="year", input_grain="year", stat="mean").value_zero == 1.5


def test_cells_are_unique_and_sound(built):
    assert checks.repeated_keys(built, [*cube.DIMS, "period_start", "period_end", "grain", "input_grain", "stat"]).count() == 0
    assert set(checks.cell_violations(built).first().asDict().values()) == {0}


def test_broken_cells_are_noticed(built):
    bad = built.withColumn("value_zero", F.when(F.col("value_zero") == 1.0, 99.0).otherwise(F.col("value_zero")))
    assert checks.cell_violations(bad).first().zero_above_limit > 0
    with pytest.raises(ValueError):
        checks.guard("unique", checks.repeated_keys(built.unionByName(built), ["place_id", "period_start", "grain", "stat"]))


def test_recomputed_another_way(facts, built):
    keys = ["place_id", "variable_id", "period_start"]
    days = built.filter("grain = 'day' AND stat = 'mean' AND input_grain = 'day' AND variable_id = 'v'").select(*keys, "value_zero")
    rows = cube.imputed(facts).filter("period_grain = 'day'").select(*keys, "v_zero")
    sample = sampling.stratified(days, ["place_id"], keys, 3)
    assert sample.count() == 3 and sampling.recomputed_means(rows, sample, keys, "v_zero", "value_zero").count() == 0
    assert sampling.recomputed_means(rows, sample.withColumn("value_zero", F.lit(77.0)), keys, "v_zero", "value_zero").count() == 3


def test_reading_cells(spark, built):
    read = lambda **k: series.cells(built, series.CellSpec(**k), {"cube": built, "site": spark.createDataFrame([("a", "m")], "place_id string, municipality string"), "place_relation": spark.createDataFrame([("a", "z1", "within"), ("b", "z2", "within"), ("a", "z2", "near")], "child_id string, parent_id string, relation string")})
    assert read(grains=("day",), scope=("places", [])).count() == 0
    assert {r.place_id for r in read(grains=("day",), scope=("places", ["b"])).collect()} == {"b"}
    assert {r.place_id for r in read(grains=("day",), scope=("water", "m")).collect()} == {"a"}
    assert {r.place_id for r in read(grains=("day",), scope=("zone", ["z2"])).collect()} == {"b"}
    assert {r.place_id for r in read(grains=("day",), scope=("site", "a")).collect()} == {"a"}
    assert read(grains=("day",), variable_id="v", period=("2024-01-01", "2024-01")).count() == 0
    assert read(grains=("day",), variable_id="v", period=("2024-01-01", "2024-01-31")).count() == 3
    assert read(grains=("day",), limit=2).count() == 3 and read(grains=("day",), region_id="none").count() == 0
    assert read(grains=("day",), series=(("rain", "day", "max", None),)).first().value_zero == 7.0
    assert {r.input_grain for r in read(grains=("year", "fiscal_year"), source_grain_only=True).collect()} == {"year", "month"}
    wide = series.pivot_stats(read(grains=("year",), stats=("mean", "min", "max"), scope=("site", "a"), input_grains=("day",))).first()
    assert (wide["min"], wide["max"]) == (1.0, 8.0)
    with pytest.raises(Exception):
        series.pivot_stats(read(grains=("day",), stats=("mean",), scope=("site", "b"))).collect()
    assert {(r.place_id, r.basis) for r in series.default_basis(read(grains=("year", "fiscal_year"), variable_id="v")).collect()} == {("a", "day"), ("b", "fiscal_year")}


def test_even_subsample(spark):
    got = [r.id for r in series.evenly(spark.range(100), ["id"], 5).orderBy("id").collect()]
    assert got == [0, 25, 50, 74, 99] and series.evenly(spark.range(3), ["id"], 5).count() == 3


def test_even_picks_cost_the_same_however_many(spark):
    """Which rows are picked is told from each row's own place: no list of all picks is made and searched for every row."""
    from decimal import ROUND_HALF_UP, Decimal

    for n, most in ((1, 3), (2, 2), (7, 5), (201, 200), (5000, 200), (5000, 4999), (30_000, 20_000)):
        m = min(n, most)
        want = [int((Decimal(k) * (n - 1) / max(m - 1, 1)).quantize(Decimal(1), ROUND_HALF_UP)) for k in range(m)]
        found = series.evenly(spark.range(n), ["id"], most)
        assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert [r.id for r in found.orderBy("id").collect()] == want, (n, most)


OCC = "record_id long, region_id string, source_id string, place_id string, taxon_id string, lat double, lon double, period_raw string, period_start string, period_end string, red_list_category string, is_alien_in_scope int"


@pytest.fixture(scope="module")
def occ(spark):
    rows = [
        (1, "r", "s", "g1", "t1", 1.0, 1.0, "x", "2024-01-05", "2024-01-05", "VU", 0), (2, "r", "s", "g1", "t1", 1.0, 1.0, "x", "2024-02-01", "2024-03-01", "", 1), (3, "r", "s", "g1", None, 1.0, 1.0, "x", "2023-12-01", "2024-03-01", None, 0),
        (4, "r", "s", None, "t2", None, None, "x", "2024-01-01", "2024-12-31", "EN", 1), (5, "r", "s", "g2", "t2", 2.0, 2.0, None, None, None, "EN", 1),
    ]
    return spark.createDataFrame(rows, OCC)


def test_occurrence_cells(spark, occ):
    places = spark.createDataFrame([(i, "watershed", "w1" if i % 2 else None) for i in range(1, 6)], "record_id long, place_kind string, place_id string")
    got = {(r.place_kind, r.grain, r.place_id, r.taxon_id, r.period_start): (r.n, r.n_red_list, r.n_alien, r.period_end) for r in occurrence_cube.cube(occ, places).collect()}
    assert got[("grid01", "year", "g1", "t1", "2024-01-01")] == (2, 1, 1, "2024-12-31")
    assert got[("grid01", "survey_period", "g1", None, "2023-12-01")] == (1, 0, 0, "2024-03-01")
    assert got[("grid01", "month", "g1", "t1", "2024-01-01")] == (1, 1, 0, "2024-01-31")
    assert got[("watershed", "year", None, "t2", "2024-01-01")] == (1, 1, 1, "2024-12-31")
    assert len(got) == 7


SPEC = {"source": "cells", "join": {"taxon": "registry"}, "filter": {"kind": ["a", "b"], "taxon.name": {"not_null": True}}, "columns": {"name": {"col": "taxon.name"}}, "group_by": ["name"], "measures": {"n": {"fn": "sum", "col": "n", "when": {"year_between": [2000, 2001]}}, "p": {"fn": "count_distinct", "col": "place"}, "y": {"fn": "max", "expr": "year_of_period_start"}}, "key": ["name"]}


def test_summary_compiler(spark):
    cells = spark.createDataFrame([("r1", "a", 1, "p", 5, "2000-01-01"), ("r2", "b", 1, "p", 7, "2002-01-01"), ("r1", "c", 1, "q", 9, "2000-01-01"), ("r1", "a", None, "q", 1, "2000-01-01")], "region_id string, kind string, taxon_id int, place string, n int, period_start string")
    taxa = spark.createDataFrame([(1, "x"), (2, "y")], "taxon_id int, name string")
    tables = {"cells": cells, "taxon": taxa}
    columns = {k: set(v.columns) for k, v in tables.items()}
    summary.check("t", SPEC, columns)
    whole, parts = summary.compile_summary(SPEC, tables), summary.compile_summary(SPEC, tables, True)
    assert [tuple(r) for r in whole.collect()] == [("x", 5, 1, 2002)] and parts.count() == 2
    assert summary.folds_back(whole, parts, SPEC).count() == 0
    assert summary.folds_back(whole.withColumn("n", F.col("n") + 1), parts, SPEC).count() == 1


@pytest.mark.parametrize("change", [{"key": ["kind"]}, {"group_by": ["nope"], "key": ["nope"]}, {"odd": 1}, {"measures": {"n": {"fn": "median", "col": "n"}}}, {"measures": {"n": {"fn": "sum"}}}, {"measures": {"n": {"fn": "sum", "col": "n", "when": {"odd": 1}}}}, {"by_region": True, "measures": {"n": {"fn": "avg", "col": "n"}}}])
def test_wrong_specs_are_refused(change):
    columns = {"cells": {"kind", "taxon_id", "place", "n", "period_start"}, "taxon": {"taxon_id", "name"}}
    with pytest.raises(ValueError):
        summary.check("t", SPEC | change, columns)


def test_reconciliation(spark):
    a = spark.createDataFrame([(1, None, 5), (2, "x", 3), (3, "y", 1)], "k int, g string, v int")
    b = spark.createDataFrame([(1, None, 4), (1, None, 1), (2, "x", 4), (4, "z", 0)], "k int, g string, v int")
    got = sorted((r.k, r.g, r.left_value, r.right_value) for r in checks.unequal_totals(a, b, ["k", "g"], "v").collect())
    assert got == [(2, "x", 3, 4), (3, "y", 1, None), (4, "z", None, 0)]
    assert {tuple(r) for r in checks.set_difference(a, b, ["k"]).collect()} == {(4, "missing"), (3, "stale")}
    assert checks.not_functional(a.unionByName(b), ["k"], ["v"]).count() == 2
    assert [r.k for r in checks.unresolved(a, b, "k").collect()] == [3]
