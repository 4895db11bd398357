"""Bounds that feedback moves: a plain loop, swinging, blends, back and forth."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import adjustments

RUN = "series string, at int, run_id string, value double, mark string, confidence double, table_rows long"


def adjusted(spark, runs, ranges, lower=10.0, upper=20.0, **more):
    h = spark.createDataFrame([("s", i, f"r{i}", *r, 1000) for i, r in enumerate(runs)], RUN)
    b = spark.createDataFrame([("s", lower, upper), ("other", 0.0, 1.0)], "series string, lower double, upper double")
    return [(r.action, r.lower, r.upper) for r in sorted(adjustments.adjusted(h, b, ranges, **more).collect(), key=lambda r: r.i)]


def test_counts_move_past_the_value(spark):
    runs = [(30.0, "normal", 0.6), (40.0, "normal", 0.7), (5.0, "normal", 0.59), (5.0, "normal", None), (15.0, "outlier", 0.79), (15.0, "outlier", 0.8), (None, "normal", 1.0), (90.0, None, 1.0), (11.0, "normal", 1.0)]
    got = adjusted(spark, runs, ranges=False)
    assert got[0] == ("expand", 10.0, 31.5)  # 30 and the margin of 1.5
    assert got[1] == ("expand", 10.0, 41.0)  # again: half of 2
    assert got[2:4] == [("", 10.0, 41.0)] * 2  # below the gate, no confidence
    assert got[4][0] == "contract"  # nothing was moved just before, so the usual gate of 0.7 holds
    assert got[4][2] == 21.0 and got[5] == ("contract", 10.0, 14.3)  # a fiftieth of the rows at once, then below the value
    assert [a for a, _, _ in got[6:]] == ["", "", ""]


def test_moves_the_other_way_need_more_confidence(spark):
    got = adjusted(spark, [(30.0, "normal", 1.0), (15.0, "outlier", 0.75)], ranges=False)
    assert got[1][0] == "" and adjusted(spark, [(30.0, "normal", 1.0), (15.0, "outlier", 0.8)], ranges=False)[1][0] == "contract"


def test_ranges_move_by_hashed_shares(spark):
    a = adjusted(spark, [(30.0, "normal", 1.0)], ranges=True)
    assert a == adjusted(spark, [(30.0, "normal", 1.0)], ranges=True) != adjusted(spark, [(30.0, "normal", 1.0)], ranges=True, seed=1)
    assert a[0][0] == "expand" and 9.2 <= a[0][1] <= 9.5 and a[0][2] == 21.0  # held to a tenth of the width
    b = adjusted(spark, [(15.0, "outlier", 1.0)], ranges=True)
    assert b[0][0] == "contract" and 9.3 <= b[0][1] <= 9.5 and 18.6 <= b[0][2] <= 19.0
    assert adjusted(spark, [(-5.0, "normal", 1.0)], ranges=True, lower=-1.0, upper=1.0, at_least_0=True)[0][1] == 0.0


@pytest.mark.parametrize(
    "lows, ups, rate, swings",
    [([1.0, 2.0], [3.0, 4.0], 0.0, False), ([1.0] * 5, [9.0] * 5, 0.0, False), ([1.0, 2.0, 1.0, 2.0, 1.0], [5.0, 9.0, 5.0, 9.0, 5.0], (1 + 1 + (3 / 4 + 3 / 7) / 2) / 3, True), ([1.0, 1.0, 1.0], [2.0, 3.0, 4.0], 0.75 / 3, False)],
)
def test_oscillation(spark, lows, ups, rate, swings):
    x = spark.createDataFrame([(lows, ups)], "a array<double>, b array<double>").select(adjustments.oscillation(F.col("a"), F.col("b")).alias("o")).first().o
    assert abs(x.rate - rate) < 1e-9 and x.swings == swings


def test_swinging_bounds_move_less(spark):
    """Marks that pull to and fro end in small steps."""
    runs = []
    for k in range(12):
        runs.append((1000.0, "normal", 1.0) if k % 2 == 0 else (15.0, "outlier", 1.0))
    got = adjusted(spark, runs, ranges=False)
    steps = [abs(u - v) + abs(x - y) for (_, x, u), (_, y, v) in zip(got, got[1:], strict=False)]
    assert max(steps[6:]) < max(steps[:3])


def test_blend(spark):
    rows = [(0.0, 10.0, 1.0, 10.5), (0.0, 10.0, 5.0, 12.0), (0.0, 10.0, 0.0, 90.0), (0.0, 10.0, None, None), (5.0, 5.0, 9.0, 9.0), (-9.0, 1.0, -9.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double")
    got = {r.i: tuple(r.x) for r in df.select("i", adjustments.blended(*(F.col(c) for c in "abcd")).alias("x")).collect()}
    assert got == {0: (0.0, 11.0), 1: (2.0, 11.0), 2: (0.0, 34.0), 3: (0.0, 10.0), 4: (5.0, 5.0), 5: (-9.0, 1.0)}
    assert df.filter("i = 5").select(adjustments.blended(*(F.col(c) for c in "abcd"), length=True).alias("x")).first().x.lower == 0.0


def test_alternation(spark):
    marks = [("s", 1.0, i, m, "Ok") for i, m in enumerate("normal outlier normal outlier".split())]
    marks += [("s", 2.0, i, "normal", "Ok") for i in range(5)] + [("s", 3.0, i, m, "High") for i, m in enumerate("normal outlier".split())] + [("s", 4.0, 1, None, "Ok")]
    marks += [("s", 5.0, i, "normal", s) for i, s in enumerate("Ok Ok Ok Ok High".split())]
    got = {r.value: (r.n, r.rate, r.alternates) for r in adjustments.alternation(spark.createDataFrame(marks, "series string, value double, at int, mark string, status string")).collect()}
    assert got == {1.0: (4, 1.0, True), 2.0: (5, 0.0, False), 3.0: (2, 1.0, False), 5.0: (5, 0.25, True)}


def test_empty(spark):
    assert adjusted(spark, [], ranges=True) == []
