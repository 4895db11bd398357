"""Seasonality, ranges, boundaries and bootstrap bounds against plain versions and planted series."""

import math
import random

import numpy as np
import pytest

from plumbline.operators import forecasts

SCHEMA = "series string, at int, run_id string, value double"


def frame(spark, series):
    return spark.createDataFrame([(s, i, str(i), None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)], SCHEMA)


def test_planted_periods_are_found(spark):
    r = random.Random(3)
    series = {f"p{p}": [100 + 40 * math.cos(2 * math.pi * i / p) + r.gauss(0, 2) for i in range(8 * p)] for p in range(2, 15)}
    series |= {"constant": [5] * 40, "short": [1, 2], "none": [None, None], "gaps": [None, 1, None, 2, 9], "line": list(range(60))}
    got = {x.series: x for x in forecasts.seasonality(frame(spark, series)).collect()}
    for p in range(3, 15):
        assert got[f"p{p}"].seasonal and got[f"p{p}"].period == p, got[f"p{p}"]
        assert got[f"p{p}"].peak == (p if p < 14 else None)  # a peak at the last lag has no neighbour
    assert got["p2"].seasonal  # the fastest wave is no frequency below half of the runs; peak and strength are
    assert not any(got[s].seasonal for s in ("constant", "short", "gaps", "line"))
    assert "none" not in got and got["gaps"].n == 3


def plain_factors(x, k=5):
    k = min(k, len(x) - 1)
    near = [sorted((j for j in range(len(x)) if j != i), key=lambda j: (abs(x[i] - x[j]), j))[:k] for i in range(len(x))]
    far = [abs(x[i] - x[near[i][-1]]) for i in range(len(x))]
    density = [1 / (sum(max(abs(x[i] - x[j]), far[j]) for j in near[i]) / k + 1e-10) for i in range(len(x))]
    return [sum(density[j] for j in near[i]) / k / density[i] for i in range(len(x))]


def test_local_outliers(spark):
    r = random.Random(5)
    x = [r.gauss(50, 3) for _ in range(19)] + [500.0]
    assert np.allclose(forecasts.outlier_factors(np.array(x)), plain_factors(x))
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", i, v) for i, v in enumerate([1.0, 1.0, 900.0, 1.0])], "series string, i int, value double")
    got = sorted((z.series, z.i, z.value) for z in forecasts.local_outliers(rows).collect())
    cut = np.percentile(plain_factors(x), 90)
    want = [("a", i, float(np.median(x)) if f > cut else v) for i, (v, f) in enumerate(zip(x, plain_factors(x), strict=True))]
    assert got[:20] == want and got[19][2] != 500.0
    assert [v for s, _, v in got if s == "b"] == [1.0, 1.0, 900.0, 1.0]


@pytest.mark.parametrize("values, model, lower, upper", [([7], "constant", 6, 8), ([12] * 9, "constant", 11, 14), ([0, 0], "constant", 0, 1), ([100.5] * 3, "constant", 95.475, 105.525), ([-4.5, -4.5], "constant", 0, -3.5)])
def test_constant_ranges(spark, values, model, lower, upper):
    x = forecasts.range_bounds(forecasts.smoothed(frame(spark, {"s": values}))).first()
    assert (x.model, round(x.lower, 6), round(x.upper, 6)) == (model, lower, upper)


def test_range_branches(spark):
    r = random.Random(1)
    series = {"line": [10, 12, 14, 16], "few": [5.5, 7.25, 6.0], "many": [20 + r.random() for _ in range(30)], "noisy": [1, 900, 2, 3, 800, 1, 1, 2, 700, 5], "down": [30, 20, 10, 2]}
    got = {x.series: x for x in forecasts.range_model(frame(spark, series)).collect()}
    assert {s: x.model for s, x in got.items()} == {"line": "line", "few": "line", "many": "smoothing", "noisy": "smoothing", "down": "line"}
    assert (got["line"].lower, got["line"].upper) == (18, 18)
    assert all(0 <= x.lower <= x.upper for x in got.values())
    # exponential smoothing as a plain loop
    best = None
    for k in range(1, 10):
        level, errors = series["many"][0], []
        for v in series["many"][1:]:
            errors.append(v - level)
            level += k / 10 * (v - level)
        best = min(best or (math.inf,), (round(sum(e * e for e in errors), 6), level, float(np.std(errors))))
    f = next(x for x in forecasts.forecasts(forecasts.latest(frame(spark, series))).collect() if x.series == "many")
    assert math.isclose(f.forecast, best[1]) and math.isclose(f.above - f.forecast, 1.96 * best[2])


def test_boundaries(spark):
    series = {"one": [4], "two": [4, 6], "still": [11, 11], "zero": [0, 0, 0], "fall": [40, 30, 20, 10], "rise": [10, 20, 30, 40]}
    h = frame(spark, series)
    low = {x.series: x.boundary for x in forecasts.boundary_forecast(h, lowest=True, length=False).collect()}
    high = {x.series: x.boundary for x in forecasts.boundary_forecast(h, lowest=False, length=True).collect()}
    assert low == {"one": 0, "two": 7, "still": 10, "zero": 0, "fall": 22, "rise": 47}
    assert high == {"one": 1, "two": 9, "still": 13, "zero": 1, "fall": 27, "rise": 55}


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    r = random.Random(2)
    h = frame(spark, {f"s{k}": [r.randrange(1000) for _ in range(3 + 9 * k)] for k in range(5)})
    a = sorted(map(tuple, forecasts.bootstrap_lower(h).collect()))
    assert a == sorted(map(tuple, forecasts.bootstrap_lower(h.repartition(7, "value")).collect()))
    assert a != sorted(map(tuple, forecasts.bootstrap_lower(h, seed=1).collect()))


def test_empty_history(spark):
    h = frame(spark, {})
    for f in (forecasts.seasonality, forecasts.range_model, forecasts.bootstrap_lower, lambda x: forecasts.boundary_forecast(x, True, True)):
        assert f(h).count() == 0


def test_outliers_of_many_series_are_those_of_each():
    import numpy as np

    from plumbline.operators.forecasts import outlier_factors

    x = np.random.default_rng(4).integers(0, 9, (20, 12)).astype(float)
    assert (outlier_factors(x) == np.stack([outlier_factors(v) for v in x])).all()


def test_draws_are_no_rows(spark):
    from plumbline.operators import forecasts

    h = spark.createDataFrame([("a", "1", "1", 2.0), ("a", "2", "2", 4.0), ("b", "1", "1", 3.0)], "series string, at string, run_id string, value double")
    found = forecasts.bootstrap_lower(h)
    assert {r.series: (r.n, r.lower) for r in found.collect()} == {"a": (2, 2.0), "b": (1, 3.0)}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_variance_of_half_the_squared_mean_is_judged_as_sql_does(spark, tmp_path):
    """Counts whose variance is half of their squared mean but for the last bit, which the order of a sum decides."""
    import duckdb

    from plumbline.plans import forecasts as plans
    from plumbline.plans.base import oracle_sql

    counts = [[1, 1, 3, 3, 1, 1, 1, 5], [1, 1, 2, 2, 1, 5], [5, 1, 1, 1, 2, 2], [2, 1, 1, 1, 1, 1, 2, 1, 3, 5, 1, 1], [2, 1, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 3, 5, 1, 1], [1, 1, 4], [3, 5, 1, 2, 1, 1, 1]]
    events = [(u, "view", d, 1.5) for u, days in enumerate(counts) for d, n in enumerate(days) for _ in range(n)]
    con = duckdb.connect()
    rows = ", ".join(f"({u}, '{t}', TIMESTAMP '2024-01-01' + INTERVAL {d} DAY, {v}::DOUBLE)" for u, t, d, v in events)
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) e(user_id, event_type, ts, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("smoothed_events", "range_bounds_events"):
        found = sorted(map(tuple, getattr(plans, name)(spark, str(tmp_path)).collect()))
        assert found == sorted(con.sql(oracle_sql()[name]).fetchall()), name


def plain_strength(v):
    n, s = len(v), float(np.std(v))
    for p in range(2, min(n // 2, forecasts.LONGEST - 1) + 1):
        h = p // 2
        whole = lambda i: sum(v[i - h : i + h + 1]) - (0 if p % 2 else (v[i - h] + v[i + h]) / 2)  # noqa: E731, B023
        by_phase = [[v[i] - whole(i) / p for i in range(h, n - h) if i % p == phase] for phase in range(p)]
        laid = [float(np.mean(by_phase[i % p])) for i in range(n)]
        if np.std(laid) / s > forecasts.STRENGTH:
            return p
    return None


def test_seasonal_means_are_found_in_a_series_own_row(spark):
    """No window a period, no rows a period and run, no join: a task holds the sorted runs, and a row a series."""
    r = random.Random(8)
    series = {f"r{n}": [r.gauss(10, 1) for _ in range(n)] for n in (3, 4, 5, 6, 9, 26, 27, 28, 60, 400)}
    series |= {f"w{p}": [1000 * math.cos(2 * math.pi * i / p) for i in range(300)] for p in (5, 12, 13)} | {"line": [i + r.gauss(0, 1e-3) for i in range(90)]}
    found = forecasts.seasonality(frame(spark, series))
    assert {x.series: x.strength for x in found.collect()} == {s: plain_strength(v) for s, v in series.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Window [") <= 2


def test_autocorrelation_of_just_the_least_peak_is_judged_as_sql_does(spark, tmp_path):
    import duckdb

    from plumbline.plans import forecasts as plans
    from plumbline.plans.base import oracle_sql

    tied = duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE (user_id, event_type) IN ((1047, 'signup'), (1271, 'signup'), (96, 'purchase'), (645, 'error')) OR user_id < 20")
    tied.write_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = sorted(map(tuple, plans.seasonality_events(spark, str(tmp_path)).collect()))
    assert found == sorted(con.sql(oracle_sql()["seasonality_events"]).fetchall())
