"""Seasonality, ranges and forecasts of metric histories (series, at, run_id, value).

A series is what one measure had in its runs; RUNS of them at most are looked
at, the latest, as older ones say little of the next. Null values don't count.
Repeated rows are runs each, in the order of at and run_id; an empty history
gives no rows; columns other than these are not read. All but ``local_outliers``
is DataFrame functions; floors and ceilings are taken of values rounded to nine
decimals, so that they don't depend on the order of a sum.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = 400
#: Least peak of autocorrelation, least strength of seasonal means, longest period.
PEAK, STRENGTH, LONGEST = 0.3, 0.1, 14
ALPHAS = [k / 10 for k in range(1, 10)]


def latest(history: DataFrame) -> DataFrame:
    """The last RUNS values of each series: series, i (from 0), value."""
    filled = history.filter("value is not null").select("series", "at", "run_id", F.col("value").cast("double").alias("value"))
    back = Window.partitionBy("series").orderBy(F.desc("at"), F.desc("run_id"))
    kept = filled.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= RUNS)
    n = F.count("*").over(Window.partitionBy("series"))
    return kept.select("series", (n - F.col("back")).cast("int").alias("i"), "value")


def _arrays(rows: DataFrame) -> DataFrame:
    """(series, v, n): a series' values in order."""
    return rows.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x.value).alias("v")).withColumn("n", F.size("v"))


# ---------------------------------------------------------------- seasonality


def _strengths(a: DataFrame) -> DataFrame:
    """``a`` (v, n, s: a series' values and their deviation) with strengths: the periods that stand twice whose seasonal means deviate over STRENGTH of that.

    Values less their centred moving mean are averaged by phase where that mean
    is whole; the phases' means, less their own mean, are laid over the series.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda x, y: x + y)

    def detrended(p: Column) -> Column:
        h = F.floor(p / 2).cast("int")
        ends = F.when(p % 2 == 0, 0.5).otherwise(0.0)
        around = lambda i: total(F.slice("v", i - h + 1, 2 * h + 1)) - ends * (F.get("v", i - h) + F.get("v", i + h))
        return F.struct(p.alias("p"), h.alias("h"), F.transform(F.sequence(h, F.col("n") - 1 - h), lambda i: F.get("v", i) - around(i) / p).alias("d"))

    def phases(x: Column) -> Column:
        def mean(phase: Column) -> Column:
            first = (phase - x.h + 2 * x.p) % x.p
            at = F.sequence(first, F.size(x.d) - 1, x.p)
            times = F.floor((F.col("n") - 1 - phase) / x.p) + 1
            return F.struct(times.alias("times"), (F.aggregate(at, F.lit(0.0), lambda acc, j: acc + F.get(x.d, j)) / F.size(at)).alias("mean"))

        return F.struct(x.p.alias("p"), F.transform(F.sequence(F.lit(0), x.p - 1), mean).alias("means"))

    def strength(x: Column) -> Column:
        square = total(F.transform(x.means, lambda m: m.times * m.mean * m.mean)) / F.col("n")
        mean = total(F.transform(x.means, lambda m: m.times * m.mean)) / F.col("n")
        return F.struct(x.p.alias("p"), F.try_divide(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), F.col("s")).alias("strength"))

    longest = F.least(F.floor(F.col("n") / 2).cast("int"), F.lit(LONGEST - 1))
    periods = F.when(F.col("open") & (longest >= 2), F.sequence(F.lit(2), F.greatest(longest, F.lit(2))))
    found = F.transform(F.transform(F.transform(periods, detrended), phases), strength)
    return a.withColumn("strengths", F.transform(F.filter(found, lambda x: x.strength > STRENGTH), lambda x: x.p))


def seasonality(history: DataFrame) -> DataFrame:
    """Whether each series is seasonal: two of three of a peak of its autocorrelation, seasonal means, and a dominant period.

    Returns series, n, peak, strength (the first period whose seasonal means are
    strong), period (the dominant one, where it is 2 to LONGEST) and seasonal.
    Series that are constant or shorter than three are not seasonal. Small counts
    often have an autocorrelation of just PEAK, where the last bit decides: products
    are added from the last run back, as the query's SQL adds them where it runs in one piece.
    """
    a = _arrays(latest(history)).withColumn("mean", F.aggregate("v", F.lit(0.0), lambda x, y: x + y) / F.col("n"))
    a = a.withColumn("c", F.transform("v", lambda x: x - F.col("mean"))).withColumn("square", F.aggregate(F.reverse("c"), F.lit(0.0), lambda x, y: x + y * y))
    open_ = (F.col("n") >= 3) & (F.array_min("v") < F.array_max("v"))
    a = a.withColumn("open", open_).withColumn("lags", F.least(F.floor(F.col("n") / 2), F.lit(LONGEST)).cast("int"))
    product = lambda k: F.aggregate(F.sequence(F.col("n") - 1 - k, F.lit(0)), F.lit(0.0), lambda acc, t: acc + F.get("c", t) * F.get("c", t + k))
    a = a.withColumn("acf", F.when(F.col("open"), F.transform(F.sequence(F.lit(0), F.col("lags")), lambda k: product(k) / F.col("square"))))
    higher = lambda k: (F.get("acf", k) > PEAK) & (F.get("acf", k) > F.get("acf", k - 1)) & (F.get("acf", k) > F.get("acf", k + 1))
    a = a.withColumn("peak", F.when(F.col("open") & (F.col("lags") >= 2), F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.col("lags") - 1, F.lit(1))), higher))))
    wave = lambda f, k: F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, t: acc + F.get("c", t) * f(2 * np.pi * k * t / F.col("n")))
    half = F.floor(F.col("n") / 2).cast("int") - 1
    power = F.transform(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda k: F.struct(F.round(F.pow(wave(F.cos, k), 2) + F.pow(wave(F.sin, k), 2), 6).alias("p"), (-k).alias("k")))
    a = a.withColumn("top", F.when(F.col("open") & (half >= 1), F.array_max(power)))
    period = F.when(F.col("top.p") > 0, F.bround(F.col("n") / -F.col("top.k"), 0).cast("int"))
    a = a.withColumn("period", F.when(period.between(2, LONGEST), period))
    found = _strengths(a.withColumn("s", F.sqrt(F.col("square") / F.col("n")))).withColumn("strength", F.array_min("strengths"))
    votes = sum((F.col(c).isNotNull().cast("int") for c in ("peak", "strength", "period")), F.lit(0))
    return found.select("series", "n", "peak", "strength", "period", (votes >= 2).alias("seasonal"))


# ---------------------------------------------------------------- ranges


def smoothed(history: DataFrame) -> DataFrame:
    """Series whose variance is over half of their squared mean, as means of three runs (the first two as the third): series, i, value.

    Small counts often have a variance of just that half, where the last bit decides: mean and
    variance are folded over the runs in order, by Welford's steps, as SQL engines do.
    """
    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def step(acc: Column, x: Column) -> Column:
        k = acc.k + 1
        mean = acc.mean + (x - acc.mean) / k
        return F.struct(k.alias("k"), (acc.total + x).alias("total"), mean.alias("mean"), (acc.square + (x - mean) * (x - acc.mean)).alias("square"))

    half = lambda s: (s.total != 0) & (s.square / s.k > 0.5 * (s.total / s.k) * (s.total / s.k))
    noisy = F.when((F.col("n") >= 3) & (F.array_min("v") < F.array_max("v")), F.aggregate("v", start, step, half))
    third = lambda i: (F.get("v", i - 2) + F.get("v", i - 1) + F.get("v", i)) / 3
    means = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: third(F.greatest(i, F.lit(2))))
    rows = _arrays(latest(history)).select("series", F.when(noisy, means).otherwise(F.col("v")).alias("v"))
    return rows.select("series", F.posexplode("v").alias("i", "value"))


def outlier_factors(x: np.ndarray, neighbours: int = 5) -> np.ndarray:
    """Local outlier factors of single values (the last axis; others are series): how much denser their neighbours lie than they do."""
    k = min(neighbours, x.shape[-1] - 1)
    apart = np.abs(x[..., :, None] - x[..., None, :])
    at = np.arange(x.shape[-1])
    apart[..., at, at] = np.inf
    near = np.argsort(apart, axis=-1, kind="stable")[..., :k]
    reach = np.take_along_axis(apart, near, -1)
    of_near = lambda each: np.take_along_axis(each, near.reshape(*x.shape[:-1], -1), -1).reshape(near.shape)
    density = 1.0 / (np.maximum(reach, of_near(reach[..., -1])).mean(axis=-1) + 1e-10)
    return of_near(density).mean(axis=-1) / density


#: Numbers in the table of distances that numpy holds at once.
_DISTANCES = 1 << 20


def local_outliers(rows: DataFrame, share: float = 0.1, least: int = 5) -> DataFrame:
    """Values (series, i, value) whose outlier factor is above that of all but ``share`` become their series' median.

    Series of fewer than ``least`` values stay. Series (RUNS values at most) of one length are a batch of numpy.
    """

    def cleaned(batches):
        for df in batches:
            values = [np.asarray(v, float) for v in df["v"]]
            by_length: dict[int, list[int]] = {}
            for k, v in enumerate(values):
                by_length.setdefault(len(v), []).append(k)
            for n, all_of in by_length.items():
                step = max(1, _DISTANCES // (n * n)) if n else 1
                for at in range(0, len(all_of) if n >= least else 0, step):
                    some = all_of[at : at + step]
                    x = np.stack([values[k] for k in some])
                    factor = outlier_factors(x)
                    x = np.where(factor > np.percentile(factor, 100 * (1 - share), axis=1, keepdims=True), np.median(x, axis=1, keepdims=True), x)
                    for k, v in zip(some, x, strict=True):
                        values[k] = v
            yield pd.DataFrame({"series": df["series"], "is": df["is"], "v": values})

    kept = rows.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x")).select("series", F.col("x.i").alias("is"), F.col("x.value").alias("v"))
    done = kept.mapInPandas(cleaned, kept.schema)
    return done.select("series", F.explode(F.arrays_zip("is", "v")).alias("x")).select("series", F.col("x.is").alias("i"), F.col("x.v").alias("value"))


def _line(rows: DataFrame) -> DataFrame:
    """By series: n, first, last, low, high, mean, and the straight line's next value with its standard error."""
    x = F.col("i").cast("double")
    fit = rows.groupBy("series").agg(
        F.count("*").alias("n"), F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"),
        F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("start"), F.regr_syy("value", x).alias("syy"), F.regr_sxx("value", x).alias("sxx"), F.avg(x).alias("mid"),
        F.bool_and((F.col("value") == F.floor("value")) & (F.col("value") >= 0)).alias("counts"),
    )
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    mse = F.when(F.col("n") > 2, left / (F.col("n") - 2)).otherwise(F.col("syy") / F.col("n"))
    error = F.sqrt(mse * (1 + 1 / F.col("n") + F.try_divide(F.pow(F.col("n") - F.col("mid"), 2), F.col("sxx"))))
    return fit.withColumns({"line": F.col("start") + F.col("slope") * F.col("n"), "line_error": error})


def _smoothing(rows: DataFrame) -> DataFrame:
    """By series: the level of exponential smoothing whose one-step errors are least (of ALPHAS), and their deviation.

    A fold over the runs in order: level, sum of squared errors, sum of errors.
    """

    def fold(alpha: float) -> Column:
        start = F.struct(F.get("v", 0).alias("level"), F.lit(0.0).alias("square"), F.lit(0.0).alias("total"))

        def step(acc: Column, x: Column) -> Column:
            e = x - acc.level
            return F.struct((acc.level + alpha * e).alias("level"), (acc.square + e * e).alias("square"), (acc.total + e).alias("total"))

        done = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), start, step)
        m = F.col("n") - 1
        spread = F.sqrt(F.greatest(done.square / m - F.pow(done.total / m, 2), F.lit(0.0)))
        return F.struct(F.round(done.square, 6).alias("square"), F.lit(alpha).alias("alpha"), done.level.alias("level"), spread.alias("error"))

    best = _arrays(rows).filter("n > 1").withColumn("best", F.array_min(F.array(*(fold(a) for a in ALPHAS))))
    return best.select("series", "best.alpha", "best.level", F.col("best.error").alias("level_error"))


def forecasts(rows: DataFrame) -> DataFrame:
    """The next value of each series (series, i, value), by the first model that fits.

    ``constant``: the value itself, within 5 % (at least 1; 2 above where it is over 10); fewer
    than eight runs: ``line``; else ``smoothing``. Bounds are 1.96 errors away.
    """
    f = _line(rows).join(_smoothing(rows), "series", "left")
    constant, value = F.col("low") == F.col("high"), F.col("first")
    model = F.when(constant, "constant").when(F.col("n") < 8, "line").otherwise("smoothing")
    f = f.withColumn("model", model)
    part = F.abs(value) * 0.05
    pick = lambda *c: F.when(F.col("model") == "constant", c[0]).when(F.col("model") == "line", c[1]).otherwise(c[2])
    below, above = F.greatest(part, F.lit(1.0)), F.greatest(part, F.when(value > 10, 2.0).otherwise(1.0))
    low = value - below
    f = f.withColumns(
        {
            "forecast": pick(value, F.col("line"), F.col("level")),
            "below": pick(F.when(value >= 0, F.greatest(low, F.lit(0.0))).otherwise(low), F.col("line") - 1.96 * F.col("line_error"), F.col("level") - 1.96 * F.col("level_error")),
            "above": pick(value + above, F.col("line") + 1.96 * F.col("line_error"), F.col("level") + 1.96 * F.col("level_error")),
        }
    )
    return f.select("series", "n", "model", "forecast", "below", "above", "first", "last", "low", "high", "mean", "counts")


def _floor(x: Column) -> Column:
    return F.floor(F.round(x, 9)).cast("double")


def _ceil(x: Column) -> Column:
    return F.ceil(F.round(x, 9)).cast("double")


def range_bounds(rows: DataFrame) -> DataFrame:
    """Lower and upper threshold of each series (series, i, value): series, n, model, lower, upper.

    Whole numbers from 0 on are held to be counts or lengths: their upper bound
    is one above the highest value at least (others 5 %); a constant's bounds lie
    one (two above 10) or 5 % away; no lower bound is below 0.
    """
    f = forecasts(rows)
    c, counts = F.col("first"), F.col("counts")
    room = F.greatest(F.lit(1.0), 0.05 * c)
    still_low = F.when(c == 0, 0.0).when(counts, F.when(c > 1, F.greatest(c - 1, F.lit(0.0))).otherwise(0.0)).otherwise(F.greatest(c - room, F.lit(0.0)))
    still_high = F.when(c == 0, 1.0).when(counts, c + F.when(c > 10, 2.0).otherwise(1.0)).otherwise(c + room)
    lower, upper = F.greatest(_floor(F.col("below")), F.lit(0.0)), _ceil(F.col("above"))
    upper = F.when(upper > F.col("high"), upper).when(counts, F.col("high") + 1).otherwise(_ceil(F.col("high") * 1.05))
    still, turned = F.col("model") == "constant", lower > upper
    return f.select(
        "series", "n", "model",
        F.when(still, still_low).when(turned, F.col("low")).otherwise(lower).alias("lower"),
        F.when(still, still_high).when(turned, F.col("high")).otherwise(upper).alias("upper"),
    )


def range_model(history: DataFrame) -> DataFrame:
    """Thresholds of each series after smoothing and without local outliers."""
    return range_bounds(local_outliers(smoothed(history)))


def boundary_forecast(history: DataFrame, lowest: bool, length: bool) -> DataFrame:
    """The next lowest or highest value (or length) that is to be expected of each series: series, forecast, boundary.

    5 % room, 10 % where the series goes that way; of constant highest lengths one more
    (two above 10), of constant highest values 10 % or one. Of two runs the step goes on. Series with one run get the default: 0 for
    a lowest value, else 1. Boundaries are whole, lowest ones not below 0 (1 for lengths that never
    were less).
    """
    f = forecasts(latest(history))
    c, constant = F.col("first"), F.col("model") == "constant"
    two = 2 * F.col("last") - c
    next_ = F.when(constant, c).when(F.col("n") == 2, two).when((F.abs("forecast") < 0.0001) & ((F.abs("low") >= 0.0001) | (F.abs("high") >= 0.0001)), F.col("mean")).otherwise(F.col("forecast"))
    f = f.withColumn("next", next_)
    if lowest:
        room = F.col("next") * (1 - F.when(~constant & (F.col("last") < c), 0.10).otherwise(0.05))
        if length:
            room = F.when(constant & (c > 0), F.greatest(room, F.lit(1.0))).otherwise(room)
        edge = _floor(F.greatest(room, F.lit(0.0)))
    else:
        room = F.col("next") * (1 + F.when(~constant & (F.col("last") > c), 0.10).otherwise(0.05))
        least = c + (F.when(c > 10, 2.0).otherwise(1.0) if length else F.greatest(c * 0.1, F.lit(1.0)))
        edge = _ceil(F.when(constant, F.greatest(room, least)).otherwise(room))
        edge = F.when((edge == 0) & ((F.col("low") != 0) | (F.col("high") != 0)), 1.0).otherwise(edge)
    default = 0.0 if lowest and not length else 1.0
    return f.select("series", F.round("next", 6).alias("forecast"), F.when(F.col("n") < 2, default).otherwise(edge).alias("boundary"))


# ---------------------------------------------------------------- bootstrap


def bootstrap_lower(history: DataFrame, draws: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """The lower bound of each series by resampling: series, n, lower.

    Draw d takes the run that a hash of (seed, series, d) names, so the bound is the same for
    any partitioning. A series' draws are an array in its row; where all values are equal they are not drawn.
    """

    def drawn(d: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("series"), d.cast("string")))
        return F.get("v", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n")).cast("int"))

    at = (draws - 1) * (1 - confidence) / 2
    low = math.floor(at)
    ordered = F.array(F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), drawn)))
    cut = F.get(F.transform(ordered, lambda x: F.get(x, low) + (at - low) * (F.get(x, min(low + 1, draws - 1)) - F.get(x, low))), 0)
    varies = F.array_min("v") < F.array_max("v")
    return _arrays(latest(history)).select("series", F.col("n").cast("long").alias("n"), F.round(F.when(varies, cut).otherwise(F.get("v", 0)), 6).alias("lower"))
