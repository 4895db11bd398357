"""How feedback moves the bounds of a series, run by run, and what keeps them from swinging.

``adjusted`` is an ordered fold over a series' runs: each may hold a mark
(``normal`` on a value outside the bounds asks for wider ones, ``outlier`` on one
inside for narrower ones), and what a mark does depends on the bounds that the
marks before it left. Its state is the bounds, the last move and the last
HISTORY bounds, from which swinging is told. Steps of range measures vary
within given shares by a hash of series and run, so that the same marks give
the same bounds.

A series is what one measure had in its runs, RUNS of them at most (the latest).
Runs without a mark, with an unknown one or without a value move nothing, nor do marks below the gate of
confidence (a null confidence is none); a series without bounds is left out; repeated rows are runs each; empty
tables give no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS, HISTORY = 400, 5
#: Gates of confidence (usual, swinging, after a move the other way), dampening after a move the same way.
EXPAND, CONTRACT = (0.6, 0.8, 0.8, 0.5), (0.7, 0.9, 0.8, 0.7)
#: Least share and spread of a range's step, and the most of its width that a side moves.
RANGE_EXPAND, RANGE_CONTRACT = (0.05, 0.03, 0.10), (0.05, 0.02, 0.15)
#: Most that a count's bound moves, absolute and in rows of the table.
COUNT_EXPAND, COUNT_CONTRACT = (50.0, 0.05), (25.0, 0.02)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), 0)


def oscillation(lows: Column, ups: Column) -> Column:
    """Whether bounds (arrays, oldest first) swing: struct of rate and swings.

    Of at least three bounds: the share of turns of lower and upper bounds (over
    0.4), of turns of their widths (over 0.5) and the mean relative change of widths
    (over 0.3); two of them, or a mean of the three over 0.5.
    """
    n = F.size(lows)
    turns = lambda a: F.aggregate(
        F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), F.lit(0), lambda acc, i: acc + F.when((F.get(a, i) - F.get(a, i - 1)) * (F.get(a, i - 1) - F.get(a, i - 2)) < 0, 1).otherwise(0)
    )

    def rated(widths: Column) -> Column:
        steps = F.filter(
            F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.when(F.get(widths, i - 1) > 0, F.abs(F.get(widths, i) - F.get(widths, i - 1)) / F.get(widths, i - 1))),
            lambda x: x.isNotNull(),
        )
        total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
        size = F.when(F.size(steps) > 0, total / F.greatest(F.size(steps), F.lit(1))).otherwise(0.0)
        return F.struct(((turns(lows) + turns(ups)) / (2 * (n - 2))).alias("bounds"), (turns(widths) / (n - 2)).alias("widths"), size.alias("size"))

    def judged(x: Column) -> Column:
        rate = (x.bounds + x.widths + F.least(x["size"], F.lit(1.0))) / 3
        votes = (x.bounds > 0.4).cast("int") + (x.widths > 0.5).cast("int") + (x["size"] > 0.3).cast("int")
        return F.struct(rate.alias("rate"), ((votes >= 2) | (rate > 0.5)).alias("swings"))

    found = _let(_let(F.zip_with(ups, lows, lambda u, w: u - w), rated), judged)
    return F.when(n >= 3, found).otherwise(F.struct(F.lit(0.0).alias("rate"), F.lit(False).alias("swings")))


def smart_bounds(action: Column, width: Column, ranges: bool, table_rows: Column) -> Column:
    """The most that a bound moves at once."""
    if ranges:
        return width * F.when(action == "expand", RANGE_EXPAND[2]).otherwise(RANGE_CONTRACT[2])
    limit = lambda fixed: F.least(F.lit(fixed[0]), table_rows * fixed[1])
    return F.when(action == "expand", limit(COUNT_EXPAND)).otherwise(limit(COUNT_CONTRACT))


def _action(acc: Column, x: Column, swings: Column) -> Column:
    """expand, contract or nothing: the mark against the bounds, if it is confident enough."""
    outside = (x.value < acc.lower) | (x.value > acc.upper)
    gate = lambda fixed, other: F.when(acc["last"] == other, fixed[2]).when(swings, fixed[1]).otherwise(fixed[0])
    wide = (x.mark == "normal") & outside & (x.confidence >= gate(EXPAND, "contract"))
    narrow = (x.mark == "outlier") & ~outside & (x.confidence >= gate(CONTRACT, "expand"))
    return F.when(wide, "expand").when(narrow, "contract").otherwise("")


def _target(acc: Column, x: Column, action: Column, ranges: bool) -> Column:
    """The bounds that a mark asks for, without limits."""
    again = F.when(acc["last"] != action, 1.0).when(action == "expand", EXPAND[3]).otherwise(CONTRACT[3])
    if ranges:
        share = lambda fixed: (fixed[0] + fixed[1] * x.chance) * again
        wide, narrow = share(RANGE_EXPAND), share(RANGE_CONTRACT)
        return F.struct(
            (acc.lower * F.when(action == "expand", 1 - wide).otherwise(1 - narrow)).alias("lower"), (acc.upper * F.when(action == "expand", 1 + wide).otherwise(1 - narrow)).alias("upper")
        )
    margin = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.abs(x.value) * 0.05)) * again
    high_half = x.value >= (acc.lower + acc.upper) / 2
    lower = F.when((action == "expand") & (x.value < acc.lower), x.value - margin).when((action == "contract") & high_half, F.greatest(x.value + margin, acc.lower)).otherwise(acc.lower)
    upper = F.when((action == "expand") & (x.value > acc.upper), x.value + margin).when((action == "contract") & ~high_half, F.least(x.value - margin, acc.upper)).otherwise(acc.upper)
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def _moved(acc: Column, x: Column, swing: Column, ranges: bool, at_least_0: bool) -> Column:
    """Bounds after a run: action, lower, upper."""

    def limited(action: Column) -> Column:
        cap = smart_bounds(action, acc.upper - acc.lower, ranges, x.table_rows)
        slow = F.when(swing.swings, F.greatest(F.lit(0.05), 1 - swing.rate * 0.95)).otherwise(1.0)

        def step(old: Column, new: Column) -> Column:
            out = old + F.greatest(-cap, F.least(cap, new - old)) * slow
            return F.round(F.greatest(out, F.lit(0.0)) if at_least_0 else out, 6)

        def kept(t: Column) -> Column:
            low, high = step(acc.lower, t.lower), step(acc.upper, t.upper)
            stays = (action == "") | (low >= high)
            return F.struct(F.when(stays, "").otherwise(action).alias("action"), F.when(stays, acc.lower).otherwise(low).alias("lower"), F.when(stays, acc.upper).otherwise(high).alias("upper"))

        return _let(_target(acc, x, action, ranges), kept)

    return _let(_action(acc, x, swing.swings), limited)


def adjusted(history: DataFrame, bounds: DataFrame, ranges: bool, at_least_0: bool = False, seed: int = 0) -> DataFrame:
    """Bounds after each run: series, i (from 0), run_id, action, lower, upper, swings (before the run).

    history: series, at, run_id, value, mark, confidence and table_rows (of the
    table then; counts only); bounds: series, lower, upper at the start.
    """
    back = Window.partitionBy("series").orderBy(F.desc("at"), F.desc("run_id"))
    latest = history.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= RUNS)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("series"), F.col("run_id")))
    chance = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    run = F.struct(
        (-F.col("back")).alias("order"), "run_id", F.col("value").cast("double").alias("value"), "mark", F.col("confidence").cast("double").alias("confidence"), chance.alias("chance"),
        F.col("table_rows").cast("double").alias("table_rows"),
    )
    runs = latest.groupBy("series").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    joined = runs.join(bounds.select("series", F.col("lower").cast("double").alias("lower"), F.col("upper").cast("double").alias("upper")), "series")
    none = F.array().cast("array<double>")
    out = "array<struct<run_id:string,action:string,lower:double,upper:double,swings:boolean>>"
    start = F.struct(F.col("lower").alias("lower"), F.col("upper").alias("upper"), F.lit("").alias("last"), none.alias("lows"), none.alias("ups"), F.array().cast(out).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        def after(swing: Column) -> Column:
            def state(m: Column) -> Column:
                kept = lambda old, new: F.slice(F.concat(old, F.array(new)), F.greatest(F.size(old) + 2 - HISTORY, F.lit(1)), F.lit(HISTORY))
                said = F.array(F.struct(x.run_id.cast("string").alias("run_id"), m.action.alias("action"), m.lower.alias("lower"), m.upper.alias("upper"), swing.swings.alias("swings")))
                return F.struct(m.lower.alias("lower"), m.upper.alias("upper"), m.action.alias("last"), kept(acc.lows, m.lower).alias("lows"), kept(acc.ups, m.upper).alias("ups"), F.concat(acc.out, said).alias("out"))

            return _let(_moved(acc, x, swing, ranges, at_least_0), state)

        return _let(oscillation(acc.lows, acc.ups), after)

    folded = joined.filter("lower is not null and upper is not null").select("series", F.aggregate("runs", start, step).getField("out").alias("out"))
    return folded.select("series", F.posexplode("out").alias("i", "x")).select("series", "i", "x.*")


def blended(lower: Column, upper: Column, previous_lower: Column, previous_upper: Column, length: bool = False) -> Column:
    """Bounds from the data with those of the run before: struct of lower and upper, whole numbers.

    The more the widths differ, the more the data's count (20, 50 or 70 %); bounds
    that meet give the data's, as do missing ones before.
    """
    width = upper - lower
    apart = F.when(width > 0, F.abs(width - (previous_upper - previous_lower)) / F.when(width > 0, width)).otherwise(0.0)
    share = F.when(apart < 0.2, 0.2).when(apart < 0.5, 0.5).otherwise(0.7)
    low, high = previous_lower + share * (lower - previous_lower), previous_upper + share * (upper - previous_upper)
    whole = F.floor(F.round(low, 9)).cast("double")
    whole = F.greatest(whole, F.lit(0.0)) if length else whole
    data = previous_lower.isNull() | previous_upper.isNull() | (low >= high)
    return F.struct(F.when(data, lower).otherwise(whole).alias("lower"), F.when(data, upper).otherwise(F.ceil(F.round(high, 9)).cast("double")).alias("upper"))


def alternation(marks: DataFrame) -> DataFrame:
    """Whether feedback on a value goes back and forth: series, value, n, rate, alternates.

    marks: series, value, at, mark, status. Of three marks on: over 60 % of them
    (with the status they were set in) differ from the one before, or the last
    three are not the same. Marks of one time go by mark and status.
    """
    said = F.concat_ws("_during_", F.lower("mark"), F.lower("status"))
    at = Window.partitionBy("series", "value").orderBy("at", "said")
    back = Window.partitionBy("series", "value").orderBy(F.desc("at"), F.desc("said"))
    rows = marks.filter("mark is not null").select("series", "value", "at", said.alias("said"))
    rows = rows.withColumn("turn", F.when(F.lag("said").over(at) != F.col("said"), 1).otherwise(0)).withColumn("back", F.row_number().over(back))
    each = rows.groupBy("series", "value").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"), F.countDistinct(F.when(F.col("back") <= 3, F.col("said"))).alias("recent"))
    rate = F.when(F.col("n") > 1, F.col("turns") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    return each.select("series", "value", "n", F.round(rate, 6).alias("rate"), ((F.col("n") >= 3) & ((rate > 0.6) | (F.col("recent") > 1))).alias("alternates"))
