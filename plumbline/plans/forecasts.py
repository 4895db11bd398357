"""Registered queries of seasonality, ranges, boundaries and bootstrap bounds."""

from __future__ import annotations

from plumbline.operators import forecasts
from plumbline.plans.base import _USERS, query, user_history


@query(
    f"""WITH {_USERS}, s AS (SELECT series, count(*) AS n, avg(value) AS m, min(value) < max(value) AND count(*) >= 3 AS open, stddev_pop(value) AS std FROM r GROUP BY 1),
    c AS (SELECT r.series, i, value, value - m AS c, n, std, least(n // 2, 14) AS lags FROM r JOIN s ON s.series = r.series WHERE open),
    a AS (SELECT x.series, y.i - x.i AS k, sum(x.c * y.c) / max((SELECT sum(c * c) FROM c z WHERE z.series = x.series)) AS acf FROM c x JOIN c y ON y.series = x.series AND y.i - x.i BETWEEN 0 AND x.lags GROUP BY 1, 2),
    b AS (SELECT series, k, acf, lag(acf) OVER w AS before, lead(acf) OVER w AS after FROM a WINDOW w AS (PARTITION BY series ORDER BY k)),
    peaks AS (SELECT series, min(k) AS peak FROM b WHERE k >= 1 AND acf > 0.3 AND acf > before AND acf > after GROUP BY 1),
    p AS (SELECT unnest(range(2, 14)) AS p),
    e AS (SELECT x.series, p, x.i % p AS phase, any_value(x.value) - sum(y.value * CASE WHEN p % 2 = 0 AND abs(y.i - x.i) = p // 2 THEN 0.5 ELSE 1 END) / p AS d
          FROM c x CROSS JOIN p JOIN c y ON y.series = x.series AND y.i BETWEEN x.i - p // 2 AND x.i + p // 2 WHERE x.n >= 2 * p AND x.i >= p // 2 AND x.i < x.n - p // 2 GROUP BY x.series, p, x.i),
    f AS (SELECT e.series, p, phase, avg(d) AS d FROM e GROUP BY 1, 2, 3),
    g AS (SELECT f.series, p, any_value(std) AS std, sum(((n - 1 - phase) // p + 1) * d * d) / any_value(n) - pow(sum(((n - 1 - phase) // p + 1) * d) / any_value(n), 2) AS var FROM f JOIN s ON s.series = f.series GROUP BY 1, 2),
    strong AS (SELECT series, min(p) AS strength FROM g WHERE sqrt(greatest(var, 0)) / std > 0.1 GROUP BY 1),
    k AS (SELECT series, unnest(range(1, n // 2)) AS k FROM s WHERE open),
    w AS (SELECT c.series, k, any_value(n) AS n, round(pow(sum(c * cos(2 * pi() * k * i / n)), 2) + pow(sum(c * sin(2 * pi() * k * i / n)), 2), 6) AS power FROM c JOIN k ON k.series = c.series GROUP BY 1, 2),
    top AS (SELECT series, CAST(round_even(n / k, 0) AS INTEGER) AS period FROM w WHERE power > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY power DESC, k) = 1)
    SELECT s.series, n, peak, strength, CASE WHEN period BETWEEN 2 AND 14 THEN period END AS period,
    (peak IS NOT NULL)::INT + (strength IS NOT NULL)::INT + (coalesce(period, 0) BETWEEN 2 AND 14)::INT >= 2 AS seasonal
    FROM s LEFT JOIN peaks ON peaks.series = s.series LEFT JOIN strong ON strong.series = s.series LEFT JOIN top ON top.series = s.series"""
)
def seasonality_events(spark, sf_dir):
    return forecasts.seasonality(user_history(spark, sf_dir))


_SMOOTHED = f"""{_USERS}, st AS (SELECT series, count(*) >= 3 AND min(value) < max(value) AND avg(value) <> 0 AND var_pop(value) > 0.5 * avg(value) * avg(value) AS noisy FROM r GROUP BY 1),
    sm AS (SELECT r.series, i, CASE WHEN NOT noisy THEN value WHEN i < 2 THEN avg(value) FILTER (i < 3) OVER (PARTITION BY r.series)
           ELSE avg(value) OVER (PARTITION BY r.series ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS value FROM r JOIN st ON st.series = r.series)"""


@query(f"WITH {_SMOOTHED} SELECT series, i, round(value, 6) AS value FROM sm")
def smoothed_events(spark, sf_dir):
    from pyspark.sql import functions as F

    return forecasts.smoothed(user_history(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _forecast_sql(rows: str) -> str:
    """``f``: the forecasts of ``rows`` (series, i, value)."""
    alphas = ", ".join(str(a) for a in forecasts.ALPHAS)
    return f"""ln AS (SELECT series, count(*) AS n, min_by(value, i) AS first, max_by(value, i) AS last, min(value) AS low, max(value) AS high, avg(value) AS mean, regr_slope(value, i) AS slope,
        regr_intercept(value, i) AS start, regr_syy(value, i) AS syy, regr_sxx(value, i) AS sxx, avg(i) AS mid, bool_and(value = floor(value) AND value >= 0) AS counts FROM {rows} GROUP BY 1),
    le AS (SELECT *, start + slope * n AS line, sqrt(CASE WHEN n > 2 THEN greatest(syy - slope * slope * sxx, 0) / (n - 2) ELSE syy / n END * (1 + 1 / n + pow(n - mid, 2) / sxx)) AS line_error FROM ln),
    al AS (SELECT unnest([{alphas}])::DOUBLE AS alpha),
    fo AS (SELECT series, i, alpha, value AS level, 0::DOUBLE AS square, 0::DOUBLE AS total FROM {rows} CROSS JOIN al WHERE i = 0
           UNION ALL SELECT fo.series, x.i, alpha, level + alpha * (x.value - level), square + (x.value - level) * (x.value - level), total + x.value - level FROM fo JOIN {rows} x ON x.series = fo.series AND x.i = fo.i + 1),
    be AS (SELECT fo.series, level, sqrt(greatest(square / (n - 1) - pow(total / (n - 1), 2), 0)) AS level_error FROM fo JOIN ln ON ln.series = fo.series AND fo.i = n - 1 AND n > 1
           QUALIFY row_number() OVER (PARTITION BY fo.series ORDER BY round(square, 6), alpha) = 1),
    f AS (SELECT le.*, CASE WHEN low = high THEN 'constant' WHEN n < 8 THEN 'line' ELSE 'smoothing' END AS model,
          CASE WHEN low = high THEN first WHEN n < 8 THEN line ELSE level END AS forecast,
          CASE WHEN n < 8 THEN line - 1.96 * line_error ELSE level - 1.96 * level_error END AS below, CASE WHEN n < 8 THEN line + 1.96 * line_error ELSE level + 1.96 * level_error END AS above
          FROM le LEFT JOIN be ON be.series = le.series)"""


@query(
    f"""WITH RECURSIVE {_SMOOTHED}, {_forecast_sql("sm")},
    b AS (SELECT *, greatest(floor(round(below, 9)), 0) AS lo, CASE WHEN ceil(round(above, 9)) > high THEN ceil(round(above, 9)) WHEN counts THEN high + 1 ELSE ceil(round(high * 1.05, 9)) END AS up FROM f)
    SELECT series, n, model, CASE WHEN model <> 'constant' THEN CASE WHEN lo > up THEN low ELSE lo END WHEN first = 0 THEN 0 WHEN counts THEN greatest(first - 1, 0) ELSE greatest(first - greatest(1, 0.05 * first), 0) END AS lower,
    CASE WHEN model <> 'constant' THEN CASE WHEN lo > up THEN high ELSE up END WHEN first = 0 THEN 1 WHEN counts THEN first + CASE WHEN first > 10 THEN 2 ELSE 1 END ELSE first + greatest(1, 0.05 * first) END AS upper FROM b"""
)
def range_bounds_events(spark, sf_dir):
    return forecasts.range_bounds(forecasts.smoothed(user_history(spark, sf_dir)))


@query()
def range_model_events(spark, sf_dir):
    """With local outliers replaced, which SQL can't express."""
    return forecasts.range_model(user_history(spark, sf_dir))


def _boundary_sql(lowest: bool, length: bool) -> str:
    step = "CASE WHEN model <> 'constant' AND last {} first THEN {} ELSE {} END"
    if lowest:
        room = f"next * (1 - {step.format('<', 0.10, 0.05)})"
        room = f"CASE WHEN model = 'constant' AND first > 0 THEN greatest({room}, 1) ELSE {room} END" if length else room
        edge, default = f"floor(round(greatest({room}, 0), 9))", 1 if length else 0
    else:
        room = f"next * (1 + {step.format('>', 0.10, 0.05)})"
        least = "first + CASE WHEN first > 10 THEN 2 ELSE 1 END" if length else "first + greatest(first * 0.1, 1)"
        edge, default = f"ceil(round(CASE WHEN model = 'constant' THEN greatest({room}, {least}) ELSE {room} END, 9))", 1
        edge = f"CASE WHEN {edge} = 0 AND (low <> 0 OR high <> 0) THEN 1 ELSE {edge} END"
    return f"""WITH RECURSIVE {_USERS}, {_forecast_sql("r")},
    x AS (SELECT *, CASE WHEN model = 'constant' THEN first WHEN n = 2 THEN 2 * last - first WHEN abs(forecast) < 0.0001 AND (abs(low) >= 0.0001 OR abs(high) >= 0.0001) THEN mean ELSE forecast END AS next FROM f)
    SELECT series, round(next, 6) AS forecast, CASE WHEN n < 2 THEN {default} ELSE {edge} END AS boundary FROM x"""


@query(_boundary_sql(True, False))
def lowest_value_boundaries_events(spark, sf_dir):
    return forecasts.boundary_forecast(user_history(spark, sf_dir), lowest=True, length=False)


@query(_boundary_sql(False, True))
def highest_length_boundaries_events(spark, sf_dir):
    return forecasts.boundary_forecast(user_history(spark, sf_dir), lowest=False, length=True)


@query(
    f"""WITH {_USERS}, z AS (SELECT series, count(*) AS n FROM r GROUP BY 1), draws AS (SELECT series, n, unnest(range(1000)) AS d FROM z),
    x AS (SELECT series, n, CAST(CAST('0x' || substr(md5('0|' || series || '|' || d), 1, 8) AS BIGINT) % n AS INTEGER) AS i FROM draws)
    SELECT x.series, n, round(quantile_cont(value, 0.025), 6) AS lower FROM x JOIN r ON r.series = x.series AND r.i = x.i GROUP BY 1, 2"""
)
def bootstrap_lower_events(spark, sf_dir):
    return forecasts.bootstrap_lower(user_history(spark, sf_dir))
