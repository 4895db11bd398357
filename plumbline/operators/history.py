"""Metric history: run windows, changes, thresholds and alerts.

A history has series, run_id, at (time) and value. Series are short and many:
they are windows or grouped arrays, never collected together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_runs(history: DataFrame, runs: int) -> DataFrame:
    """The last ``runs`` rows of each series."""
    order = Window.partitionBy("series").orderBy(F.desc("at"), F.desc("run_id"))
    return history.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= runs).drop("rn")


def percent_change(history: DataFrame) -> DataFrame:
    """Change against the value before, in percent: 0 if equal, value * 100 after a zero."""
    order = Window.partitionBy("series").orderBy("at", "run_id")
    v, p = F.col("value"), F.col("previous")
    change = F.when(v == p, F.lit(0.0)).when(p == 0, v * 100).otherwise(F.round((v - p) / p * 100, 4))
    return history.withColumn("previous", F.lag("value").over(order)).withColumn("change", change)


def percent_threshold(history: DataFrame) -> DataFrame:
    """Mean -+ the sample deviation of the percent changes of each series."""
    grouped = percent_change(history).groupBy("series").agg(F.avg("change").alias("m"), F.stddev_samp("change").alias("s"))
    return grouped.select("series", F.round(F.col("m") - F.col("s"), 3).alias("lower"), F.round(F.col("m") + F.col("s"), 3).alias("upper"))


def deviation_by_series(history: DataFrame, runs: int) -> DataFrame:
    """Sample deviation of the last ``runs`` values of each series."""
    return last_runs(history, runs).groupBy("series").agg(F.round(F.stddev_samp("value"), 3).alias("deviation"), F.count("value").alias("runs"))


def rolling_mean(history: DataFrame) -> DataFrame:
    """Centred mean of three; the ends take the nearest mean there is."""
    order = Window.partitionBy("series").orderBy("at", "run_id")
    whole = F.count("value").over(order.rowsBetween(-1, 1)) == 3
    mean = history.withColumn("mean", F.when(whole, F.avg("value").over(order.rowsBetween(-1, 1))))
    back = F.first("mean", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    forward = F.last("mean", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return mean.withColumn("mean", F.round(F.coalesce("mean", back, forward), 3))


def first_rows(df: DataFrame, by: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each group: the first alert of a run, the latest job of an asset, the latest feedback of a rounded value."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def steady_status(history: DataFrame) -> DataFrame:
    """Ok where a value equals the one before (or is the first), else High: for counts of columns."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy("at", "run_id"))
    return history.withColumn("status", F.when(before.isNull() | (before == F.col("value")), "Ok").otherwise("High"))


def compared(left: DataFrame, right: DataFrame, condition: str, value1: float, value2: float | None = None, unit: float = 1.0) -> DataFrame:
    """Latest values of two histories by series: their difference in a unit, and whether it meets a condition
    (gt, lt, ge, le, eq, between, notbetween)."""
    latest = [first_rows(h, ["series"], [F.desc("at"), F.desc("run_id")]).select("series", F.col("value").alias(n)) for h, n in ((left, "source"), (right, "target"))]
    d = F.abs(F.col("source") - F.col("target")) / unit
    tests = {"gt": d > value1, "lt": d < value1, "ge": d >= value1, "le": d <= value1, "eq": d == value1}
    if value2 is not None:
        tests |= {"between": d.between(value1, value2), "notbetween": ~d.between(value1, value2)}
    return latest[0].join(latest[1], "series").select("series", "source", "target", F.round(d, 4).alias("difference"), tests[condition].alias("met"))


def recent(history: DataFrame, days: int = 0, months: int = 0) -> DataFrame:
    """Runs within days or months of the latest run of their series."""
    latest = history.groupBy("series").agg(F.max(F.to_date("at")).alias("latest"))
    first = F.add_months("latest", -months) if months else F.date_sub("latest", days)
    return history.join(latest, "series").filter(F.to_date("at") > first).select(*history.columns)


def collected(history: DataFrame) -> DataFrame:
    """series and its values in time order, as a JSON array."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "run_id", "value")))
    return history.groupBy("series").agg(F.to_json(F.transform(ordered, lambda x: x["value"])).alias("history"))


def without_outliers(history: DataFrame, cut: float = 2.0) -> DataFrame:
    """Values more than ``cut`` (population) deviations from their series' mean become its median; a series without
    deviation stays."""
    stats = history.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.median("value").alias("middle"))
    far = F.abs(F.col("value") - F.col("m")) > cut * F.col("s")
    return history.join(stats, "series").withColumn("value", F.when(far, F.col("middle")).otherwise(F.col("value"))).select(*history.columns)


def weighed_by_feedback(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """Values as users marked them (series, value, accepted): rejected ones become the median of their series;
    accepted ones up to the median are halved, others grow by half. One mark a value."""
    middle = history.groupBy("series").agg(F.median("value").alias("middle"))
    v, m = F.col("value"), F.col("middle")
    new = F.when(~F.col("accepted"), m).when(F.col("accepted"), F.when(v <= m, v * 0.5).otherwise(v * 1.5)).otherwise(v)
    return history.join(middle, "series").join(feedback, ["series", "value"], "left").withColumn("value", new).select(*history.columns)


def data_share(feedback_now: Column, feedback_runs_ago: Column) -> Column:
    """How far data, not feedback, moves a threshold: all the way where there never was feedback."""
    # fixed values: shares by the runs since the last feedback
    ago = feedback_runs_ago
    past = F.when(ago <= 2, 0.20).when(ago <= 5, 0.40).when(ago <= 15, 0.60).otherwise(0.75)
    return F.when(feedback_now, 0.15).when(ago.isNull(), 1.0).otherwise(past)


def feedback_action(mark: Column, status: Column) -> Column:
    """What a mark (normal or outlier) on an alert or an Ok value asks for."""
    return F.when((mark == "normal") & (status != "Ok"), "expand").when((mark == "outlier") & (status == "Ok"), "contract").otherwise("conflicted")


def since_reset(history: DataFrame, resets: DataFrame) -> DataFrame:
    """Runs from the last reset of their series (series, reset_at) on; of a series with a reset and no run since, the latest one."""
    last = resets.groupBy("series").agg(F.max("reset_at").alias("reset_at"))
    latest = history.groupBy("series").agg(F.max("at").alias("latest"))
    kept = F.col("reset_at").isNull() | (F.col("at") >= F.least("reset_at", "latest"))
    return history.join(latest, "series").join(last, "series", "left").filter(kept).select(*history.columns)


def linked_alerts(alerts: DataFrame, runs: int) -> DataFrame:
    """Raised alerts with the run of the last one raised among the ``runs`` runs before (null: a new issue)."""
    before = Window.partitionBy("series").orderBy("at", "run_id").rowsBetween(-runs, -1)
    earlier = F.last(F.when(F.col("raised"), F.col("run_id")), ignorenulls=True).over(before)
    return alerts.withColumn("linked_run", earlier).filter("raised")


def linear_forecast(history: DataFrame) -> DataFrame:
    """The straight line through each series by run number, and its next value."""
    order = Window.partitionBy("series").orderBy("at", "run_id")
    x = history.withColumn("i", F.row_number().over(order).cast("double"))
    line = x.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("start"))
    return line.select("series", "n", F.round("slope", 3).alias("slope"), F.round(F.col("start") + F.col("slope") * (F.col("n") + 1), 3).alias("forecast"))


def autoregression(history: DataFrame) -> DataFrame:
    """Each value by the one before, with least squares, and the next value."""
    order = Window.partitionBy("series").orderBy("at", "run_id")
    x = history.withColumn("p", F.lag("value").over(order))
    fit = x.groupBy("series").agg(F.regr_slope("value", "p").alias("a"), F.regr_intercept("value", "p").alias("c"), F.max_by("value", F.struct("at", "run_id")).alias("latest"))
    return fit.select("series", F.round("a", 3).alias("slope"), F.round(F.col("c") + F.col("a") * F.col("latest"), 3).alias("forecast"))


def autoregression_bounds(history: DataFrame) -> DataFrame:
    """The next value of a first-order autoregression with its 95 % interval: series, n, forecast, lower (not below 0), upper.

    Series of fewer than three values, and constant ones, have no fit and null bounds.
    """
    order = Window.partitionBy("series").orderBy("at", "run_id")
    x = history.withColumn("p", F.lag("value").over(order)).withColumn("y", F.when(F.col("p").isNotNull(), F.col("value")))
    fit = x.groupBy("series").agg(
        F.count("value").alias("n"), F.regr_slope("value", "p").alias("a"), F.regr_intercept("value", "p").alias("c"), F.max_by("value", F.struct("at", "run_id")).alias("latest"),
        F.regr_syy("value", "p").alias("syy"), F.regr_sxx("value", "p").alias("sxx"), F.count("y").alias("k"),
    )
    forecast = F.col("c") + F.col("a") * F.col("latest")
    # residuals of least squares have a mean of 0
    error = F.sqrt(F.try_divide(F.greatest(F.col("syy") - F.col("a") * F.col("a") * F.col("sxx"), F.lit(0.0)), F.col("k")))
    fitted = F.col("n") >= 3
    return fit.select(
        "series", "n", F.when(fitted, F.round(forecast, 2)).alias("forecast"),
        F.when(fitted & forecast.isNotNull(), F.round(F.greatest(forecast - 1.96 * error, F.lit(0.0)), 2)).alias("lower"), F.when(fitted, F.round(forecast + 1.96 * error, 2)).alias("upper"),
    )


def z_interval(history: DataFrame) -> DataFrame:
    """Mean -+ 1.959964 population deviations / sqrt(n)."""
    grouped = history.groupBy("series").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    half = F.lit(1.959964) * F.col("s") / F.sqrt("n")
    return grouped.select("series", "n", F.round(F.col("m") - half, 3).alias("lower"), F.round(F.col("m") + half, 3).alias("upper"))


def range_observer(history: DataFrame, rows: int = 5) -> DataFrame:
    """Moving mean of the last rows, per run."""
    frame = Window.partitionBy("series").orderBy("at", "run_id").rowsBetween(-(rows - 1), 0)
    return history.select("series", "run_id", F.round(F.avg("value").over(frame), 3).alias("moving"), F.round(F.min("value").over(frame), 3).alias("low"), F.round(F.max("value").over(frame), 3).alias("high"))


def ewma(history: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted mean of each series in time order."""
    ordered = history.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("at", "run_id", "value"))).alias("s"))
    first = F.get(F.col("s.value"), 0)
    rest = F.slice(F.col("s.value"), F.lit(2), F.size("s"))
    return ordered.select("series", F.round(F.aggregate(rest, first, lambda acc, x: acc * (1 - alpha) + x * alpha), 3).alias("ewma"))


def auto_status(value: Column, lower: Column, upper: Column, std: Column) -> Column:
    """Ok, Low, Medium or High by how far outside the bounds, in bands by deviation."""
    up = F.ceil(value * 100) / 100
    # fixed values: bands in deviations, and in shares of the bounds where there is no deviation
    near = F.when(std <= 10, 3.0).when(std <= 10_000, 1.5).otherwise(1.0)
    far = F.when(std <= 10, 6.0).when(std <= 10_000, 2.5).otherwise(1.2)
    straddles = (std > 150) & (std <= 10_000) & (lower < 0) & (upper > 0)
    near, far = F.when(straddles, 1.0).otherwise(near), F.when(straddles, 1.2).otherwise(far)
    zero = (lower == 0) & (upper == 0)
    still = lambda bound, share: F.when(zero, share[2]).when(up >= 100_000, bound * share[1]).otherwise(bound * share[0])
    first = lambda bound: F.when(std == 0, still(bound, (0.2, 0.01, 1.5))).otherwise(near * std)
    second = lambda bound: F.when(std == 0, still(bound, (0.4, 0.02, 2.5))).otherwise(far * std)
    low = lambda band: F.when(value >= 0, F.greatest(F.round(lower - band(lower), 2), F.lit(0.0))).otherwise(F.round(lower - band(lower), 2))
    high = lambda band: F.round(upper + band(upper), 2)
    return (
        F.when(value.isNull() | lower.isNull() | upper.isNull(), F.lit(None).cast("string"))
        .when((up >= lower) & (up <= upper), "Ok")
        .when((up >= low(first)) & (up <= high(first)), "Low")
        .when((up >= low(second)) & (up <= high(second)), "Medium")
        .otherwise("High")
    )


def alerts(history: DataFrame) -> DataFrame:
    """Each value against the mean of its series -+ one deviation (whole numbers): bounds, status and deviation."""
    b = history.groupBy("series").agg(F.avg("value").alias("m"), F.round(F.stddev_pop("value"), 2).alias("std"))
    x = history.join(b, "series").withColumns({"lower": F.floor(F.col("m") - F.col("std")).cast("double"), "upper": F.ceil(F.col("m") + F.col("std")).cast("double")})
    c = [F.col(k) for k in ("value", "lower", "upper", "std")]
    return x.withColumn("status", auto_status(*c)).withColumn("deviation", deviation(*c, F.col("status")))


def manual_status(value: Column, rules: list[tuple[str, Column]]) -> Column:
    """The first of High, Medium, Low whose (typed) condition holds; a condition that can't be decided counts as met."""
    out = F.lit("Ok")
    for priority in ("Low", "Medium", "High"):
        for name, condition in rules:
            if name == priority:
                out = F.when(F.coalesce(condition, F.lit(True)), priority).otherwise(out)
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(out)


def deviation(value: Column, lower: Column, upper: Column, std: Column, status: Column) -> Column:
    """0 inside the bounds, else how many deviations from their middle (a level plus the relative distance without deviation)."""
    middle = (lower + upper) / 2
    level = F.when(status == "Low", 1).when(status == "Medium", 2).otherwise(3)
    apart = F.abs(value - middle) / F.greatest(F.abs(middle), F.lit(1.0))
    return F.when((value >= lower) & (value <= upper), 0.0).when(std == 0, F.round(level + apart, 2)).otherwise(F.round(F.abs(value - middle) / std, 2))


def gated(alerts: DataFrame, history: DataFrame, least: int = 3) -> DataFrame:
    """Alerts of series with more runs than ``least``."""
    return alerts.join(history.groupBy("series").agg(F.count("*").alias("runs")).filter(F.col("runs") > least).select("series"), "series", "left_semi")


def confidence(base: Column, days: Column) -> Column:
    """Feedback confidence decays by 5 % a day, to 0.3 at least."""
    return F.greatest(F.lit(0.3), base * F.pow(F.lit(0.95), days))


# ---------------------------------------------------------------- threshold models


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection of the regularised incomplete beta."""

    def beta(a: float, b: float, x: float) -> float:
        """The continued fraction of I_x(a, b)."""
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        value = 0.0
        for m in range(200, 0, -1):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            value = even / (1 + odd / (1 + value))
        first = -(a + b) * x / (a + 1)
        return front / a / (1 + first / (1 + value))

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - 0.5 * beta(df / 2, 0.5, df / (df + mid * mid)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def hampel(x: np.ndarray, reach: int = 10, cut: float = 3 * 1.4826) -> np.ndarray:
    """Outliers of the first 80 % (series of more than five): farther from the window's mean than ``cut`` mean deviations; they become the mean."""
    out = x.astype(float)
    if len(x) <= 5:
        return out
    for i in range(int(len(x) * 0.8)):
        w = x[max(0, i - reach) : i + reach + 1]
        m = w.mean()
        if abs(x[i] - m) > cut * np.abs(w - m).mean():
            out[i] = m
    return out


def thresholds(history: DataFrame) -> DataFrame:
    """Lower and upper bound of each series: constant, short, or t interval at 98 % after cleaning."""

    def model(df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(["at", "run_id"])["value"].dropna().to_numpy(float)
        name, n = df["series"].iloc[0], len(x)
        if n == 0:
            return pd.DataFrame({"series": [name], "model": ["none"], "lower": [None], "upper": [None]})
        if np.all(x == x[0]):
            kind, lo, hi = "constant", float(int(x[0])), float(int(x[0]))
        elif n <= 3:
            kind, lo, hi = "short", float(x.min()), float(x.mean())
        else:
            c = hampel(x)
            s = c.std(ddof=1)
            half = t_quantile(0.99, n - 1) * s / math.sqrt(n)
            kind, lo, hi = "t_interval", c.mean() - half, c.mean() + half
            if s < 10:
                lo, hi = lo - s, hi + s
            lo, hi = math.floor(lo), math.ceil(hi)
            if (x >= 0).all():
                lo = max(0, lo)
            if (x <= 0).all():
                hi = min(0, hi)
        return pd.DataFrame({"series": [name], "model": [kind], "lower": [float(min(lo, hi))], "upper": [float(max(lo, hi))]})

    return history.groupBy("series").applyInPandas(model, "series string, model string, lower double, upper double")
