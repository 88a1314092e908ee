"""Record sets: only declared columns can be asked for, and only columns that are used bring joins and reads."""

import re

import pytest

from shizuku.operators import records
from shizuku.operators.records import Lookup, RecordSet
from shizuku.plans.record_sets import SETS, tables_of


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_declarations_fit_the_tables(spark, sf_dir):
    assert len(SETS) == 15
    for name, declared in SETS.items():
        assert declared.problems(tables_of(spark, sf_dir)) == [], name
    wrong = RecordSet("region", "id", {"a": "r_regionkey", "b": "r_colour"}, lookups=(Lookup("nation", "n_regionkey", "r_regionkey", {"a": "count(*)"}, True),))
    assert len(wrong.problems(tables_of(spark, sf_dir))) == 3


def test_joins_only_for_chosen_columns(spark, sf_dir):
    ask = lambda **how: plan(records.read(tables_of(spark, sf_dir), SETS["sites"], any_source=True, limit=None, **how))
    joins = lambda **how: len(re.findall(r"\bJoin\b", ask(**how)))
    assert joins(select=["site_id", "name"]) == 0 and joins(select=["site_id", "nation"]) == 1 and joins(select=["site_id", "n_values"]) == 1 and joins() == 2
    assert joins(select=["site_id", "title"]) == 1 and joins(select=["site_id"], equal={"region_id": 1}) == 1 and joins(select=["site_id"], equal={"zone_id": 1}) == 0
    # A folded lookup computes what is chosen of it, and scans read what is used.
    assert "max(l_shipdate" not in ask(select=["n_values"])
    scans = records.read(tables_of(spark, sf_dir), SETS["sites"], ["site_id", "n_values"], any_source=True, limit=None)._jdf.queryExecution().executedPlan().toString()
    assert "s_name" not in scans and "s_acctbal" not in scans and "l_shipdate" not in scans


def test_what_can_be_asked(spark, sf_dir):
    ask = lambda name, **how: records.read(tables_of(spark, sf_dir), SETS[name], **how)
    for bad in (dict(select=["s_name"], any_source=True), dict(order=[("s_acctbal", True)], any_source=True), dict(equal={"password": 1}, any_source=True), dict(between={"site_id": (1, 2)}, any_source=True), dict(between={"balance": (1, float("inf"))}, any_source=True), dict(between={"balance": ("1", 2)}, any_source=True), dict(geometry=True, any_source=True), {}):
        with pytest.raises(ValueError):
            ask("sites", **bad)
    with pytest.raises(ValueError, match="no sources"):
        ask("documents", source="x")
    assert ask("pages", select=["page_id"], geometry=True).columns == ["page_id", "html"] and "html" not in ask("pages").columns
    first = ask("surveys", source="1-URGENT", select=["survey_id"], limit=7)
    ids = [r.survey_id for r in first.collect()]
    rest = ask("surveys", source="1-URGENT", select=["survey_id"], after=ids[-1], limit=10**9)
    assert ids == sorted(ids) and len(ids) == 7 and min(r.survey_id for r in rest.collect()) > ids[-1] and rest.count() <= records.LARGEST
    assert ask("surveys", any_source=True, id=ids[0]).count() == 1
    names = {r.name for r in ask("zones", any_source=True, text="NAT").collect()}
    assert names and all("nat" in x.lower() for x in names) and ask("values", any_source=True, text="x").count() == 0
