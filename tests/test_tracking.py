"""Groups with limits, learned ranges, bounds from two sources, versions, constraints, exports."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import tracking


def test_groups_have_their_own_limits(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 7.0), ("c", None)], "g string, v double")
    measured = tracking.grouped_measures(df, ["g"], [("sum", "v"), ("count", "v")])
    got = {(r.g, r.measure): (r.value, r.n) for r in measured.collect()}
    assert got["a", "sum_v"] == (4.0, 2) and got["c", "sum_v"] == (None, 1) and got["c", "count_v"] == (0.0, 1) and got[None, "sum_v"] == (7.0, 1)
    limits = [(None, "sum_v", "Low", None, 5.0), ("a", "sum_v", "High", None, 3.0), ("a", "sum_v", "Medium", 5.0, None), (None, "count_v", "Medium", 1.0, None), ("b", "count_v", "Low", 0.0, 9.0)]
    alerts = {r.g: (r.status, json.loads(r.met)) for r in tracking.grouped_alerts(measured, ["g"], spark.createDataFrame(limits, "g string, measure string, priority string, lower double, upper double")).collect()}
    assert alerts == {
        "a": ("High", [{"measure": "sum_v", "priority": "High"}, {"measure": "sum_v", "priority": "Medium"}]),
        "b": ("Low", [{"measure": "sum_v", "priority": "Low"}]), None: ("Low", [{"measure": "sum_v", "priority": "Low"}]), "c": ("Medium", [{"measure": "count_v", "priority": "Medium"}]),
    }


def test_learned_ranges(spark):
    runs = [("a", i, float(i), 10.0 + i) for i in range(5)] + [("still", i, 4.0, 4.0) for i in range(3)] + [("new", i, 0.0, 1.0) for i in range(2)] + [("gone", i, 0.0, 1.0) for i in range(3)]
    ranges = tracking.learned_ranges(spark.createDataFrame(runs, "measure string, at int, low double, high double"))
    assert {r.measure: (r.lower, r.upper) for r in ranges.collect()} == {"a": (-0.7, 14.7), "still": (3.8, 4.2), "gone": (-0.05, 1.05)}
    df = spark.createDataFrame([(-1.0, 4.0), (14.7, 5.0), (None, None)], "a double, s double")
    got = {r.measure: (r.total_count, r.outside, r.score) for r in tracking.outside_learned(df, {"a": F.col("a"), "still": F.col("s"), "new": F.col("a")}, ranges).collect()}
    assert got == {"a": (3, 1, 66.6667), "still": (3, 1, 66.6667)}
    assert tracking.outside_learned(df.limit(0), {"a": F.col("a")}, ranges).first().score is None


@pytest.mark.parametrize("other, ranges, want", [((0.0, 10.0), True, True), ((1.5, 10.0), True, True), ((1.6, 10.0), True, False), ((1.6, 10.0), False, True), ((0.0, 12.1), False, False)])
def test_aligned(spark, other, ranges, want):
    assert spark.range(1).select(tracking.aligned(F.lit(0.0), F.lit(10.0), F.lit(other[0]), F.lit(other[1]), ranges)).first()[0] is want


def test_contaminated_and_prioritised(spark):
    bad = lambda low, high, length=False: spark.range(1).select(tracking.contaminated(F.lit(low).cast("double"), F.lit(high).cast("double"), F.lit(0.0), F.lit(10.0), length)).first()[0]
    assert [bad(0, 24), bad(0, 30), bad(-16, 12), bad(-60, 0, True), bad(None, 3), bad(1, 9)] == [False, True, True, True, False, False]
    mixed = lambda share, f: tuple(spark.range(1).select(tracking.prioritised(F.lit(share), (F.lit(0.0), F.lit(10.0)), tuple(F.lit(x).cast("double") for x in f)).alias("b")).first().b)
    assert mixed(0.2, (5, 20)) == (4.0, 18.0) and mixed(1.0, (5, 20)) == (0.0, 10.0) and mixed(0.5, (None, 3)) == (0.0, 10.0) and mixed(0.2, (9, 3)) == (0.0, 10.0)


def test_versions(spark):
    runs = [{"a": "int"}, {"a": "int"}, {"a": "int", "b": "int"}, {"a": "int", "b": "int", "c": "int"}, {"a": "long", "b": "int", "c": "int"}, {"b": "int"}, {"b": "int", "x": "int"}]
    rows = [("t", i, c, k) for i, columns in enumerate(runs) for c, k in columns.items()] + [("other", 3, "z", "int")]
    df = spark.createDataFrame(rows + rows[:1], "asset string, at int, column_name string, datatype string")
    got = {(r.asset, r.at): (r.added, r.removed, r.retyped, r.version) for r in tracking.versions(df, digits=3, most=1).collect()}
    assert [got["t", i][3] for i in range(7)] == ["1.0.0", "1.0.0", "1.0.1", "2.0.0", "3.0.0", "4.0.0", "4.0.1"]
    assert got["t", 4][:3] == (0, 0, 1) and got["t", 5][:3] == (0, 2, 0) and got["other", 3] == (0, 0, 0, "1.0.0")


def test_constraints(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, None), (3, "z"), (4, "q")], "at int, v string")
    seen = tracking.observed_constraints(df, F.col("at"), ["v"])
    assert {r.at: (r.not_null, r.unique) for r in seen.collect()} == {1: (True, True), 2: (True, False), 3: (False, True), 4: (True, True)}
    got = sorted((r.at, r.constraint, r.change) for r in tracking.constraint_changes(seen).collect())
    assert got == [(1, "not_null", "created"), (1, "unique", "created"), (2, "unique", "deactivated"), (3, "not_null", "deactivated"), (3, "unique", "created"), (4, "not_null", "created")]


def test_exports(spark):
    failed = spark.createDataFrame([(i, "r") for i in range(7)] + [(1, "s")], "k int, rule string").repartition(3)
    got = sorted((r.run, r.rule, r.k, r.number, r.total_failed) for r in tracking.exported_failures(failed, {"run": "1"}, 3, ["k"]).collect())
    assert got == [("1", "r", 0, 1, 7), ("1", "r", 1, 2, 7), ("1", "r", 2, 3, 7), ("1", "s", 1, 1, 1)]
