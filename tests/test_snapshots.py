import pytest

from shizuku.operators import snapshots


def test_grid_spreads_evenly():
    assert snapshots.evenly(list(range(10)), 4) == [0, 3, 6, 9] and snapshots.evenly([1, 2], 5) == [1, 2] and snapshots.evenly([3, 4], 1) == [3]
    assert snapshots.evenly([], 3) == [] and len(set(snapshots.evenly(list(range(1000)), 37))) == 37
    assert snapshots.grid({"a": [1, 2, 3], "b": ["x"]}, 2) == [{"a": 1, "b": "x"}, {"a": 3, "b": "x"}]
    with pytest.raises(ValueError):
        snapshots.evenly([1], 0)


def _answers(spark, rows):
    df = spark.createDataFrame(rows, "p int, k string, n long, x double, tags array<string>")
    return snapshots.snapshot("q", lambda p: df.filter(f"p = {p}").drop("p"), [{"p": 1}, {"p": 2}], ["k"])


def test_changes_are_located(spark):
    rows = [(1, "a", 1, 0.1 + 0.2, ["u"]), (1, "b", 2, None, None), (1, None, 3, float("nan"), []), (2, "a", 4, 1.0, ["v"]), (2, "a", 5, 1.0, ["v"])]
    before = _answers(spark, rows)
    assert snapshots.changes(before, _answers(spark, list(reversed(rows))).repartition(3)).count() == 0
    after = [(1, "a", 1, 0.3, ["u"]), (1, "b", 2, 0.0, None), (1, None, 3, float("nan"), []), (2, "a", 4, 1.0, ["v"]), (2, "a", 6, 1.0, ["w"]), (2, "c", 7, None, None)]
    found = {(r.parameters, r.row_key, r.nth, r.column_name): (r.kind, r.before, r.after) for r in snapshots.changes(before, _answers(spark, after)).collect()}
    assert found == {
        ('{"p":1}', '{"k":"b"}', 1, "x"): ("changed", None, "0.0"),
        ('{"p":2}', '{"k":"a"}', 2, "n"): ("changed", "5", "6"),
        ('{"p":2}', '{"k":"a"}', 2, "tags"): ("changed", '{"v":["v"]}', '{"v":["w"]}'),
        ('{"p":2}', '{"k":"c"}', 1, "n"): ("added", None, "7"),
        ('{"p":2}', '{"k":"c"}', 1, "x"): ("added", None, None),
        ('{"p":2}', '{"k":"c"}', 1, "tags"): ("added", None, None),
    }
    gone = snapshots.changes(before, _answers(spark, rows[:-1]))
    assert {(r.kind, r.column_name, r.before) for r in gone.collect()} == {("removed", "n", "5"), ("removed", "x", "1.0"), ("removed", "tags", '{"v":["v"]}')}


def test_empty_answers_and_those_that_tell_nothing(spark):
    empty, one = _answers(spark, []), _answers(spark, [(1, "a", 1, None, None)])
    assert empty.count() == 0 and snapshots.changes(empty, empty).count() == 0 and snapshots.changes(empty, one).count() == 3
    assert [(r["query"], r.most_rows) for r in snapshots.told_nothing(one).collect()] == [("q", 1)]
    assert snapshots.told_nothing(_answers(spark, [(1, "a", 1, None, None), (1, "b", 1, None, None)])).count() == 0
    keys_only = snapshots.cells(spark.range(2), "ids", {}, ["id"])
    assert sorted((r.row_key, r.column_name) for r in keys_only.collect()) == [('{"id":0}', ""), ('{"id":1}', "")]
    with pytest.raises(ValueError):
        snapshots.snapshot("q", lambda: None, [], [])
