"""Registered queries of bounds that feedback moves.

No table holds feedback, so a user's day is taken as a run of a measure (the
highest value), and what else happened that day as the mark: an error says that
the value was an outlier, a signup that it was normal.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import adjustments
from plumbline.plans.base import query, t


def marked_history(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series"), F.date_format("ts", "yyyy-MM-dd").alias("at"), "value", "event_type")
    daily = e.groupBy("series", "at").agg(F.max("value").alias("value"), F.count("*").alias("n"), *(F.max(F.col("event_type") == k).alias(k) for k in ("error", "signup")))
    mark = F.when(F.col("error"), "outlier").when(F.col("signup"), "normal")
    return daily.select("series", "at", F.col("at").alias("run_id"), "value", mark.alias("mark"), F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n")).alias("confidence"), (100 * F.col("n")).alias("table_rows"))


def start_bounds(history):
    """A deviation around the mean, in whole numbers."""
    b = history.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return b.select("series", F.floor(F.col("m") - F.col("s")).cast("double").alias("lower"), F.ceil(F.col("m") + F.col("s")).cast("double").alias("upper"))


_MARKED = """m AS (SELECT CAST(user_id AS VARCHAR) AS series, strftime(ts, '%Y-%m-%d') AS "at", max(value) AS value, 100.0 * count(*) AS table_rows, least(1.0, 0.5 + 0.1 * count(*)) AS confidence,
        CASE WHEN bool_or(event_type = 'error') THEN 'outlier' WHEN bool_or(event_type = 'signup') THEN 'normal' END AS mark FROM events GROUP BY 1, 2),
    x AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY "at") - 1 AS INTEGER) AS i, CAST('0x' || substr(md5('0|' || series || '|' || "at"), 1, 8) AS BIGINT) / 4294967296.0 AS chance FROM m),
    b AS (SELECT series, floor(avg(value) - stddev_pop(value)) AS lower, ceil(avg(value) + stddev_pop(value)) AS upper FROM m GROUP BY 1)"""


def _fold_sql(ranges: bool) -> str:
    """``fold``: the bounds after each run (i from 0; -1: the start)."""
    turns = lambda a: f"list_sum([CASE WHEN ({a}[j] - {a}[j - 1]) * ({a}[j - 1] - {a}[j - 2]) < 0 THEN 1 ELSE 0 END FOR j IN range(3, len(lows) + 1)])"
    again = "CASE WHEN last <> action THEN 1.0 WHEN action = 'expand' THEN 0.5 ELSE 0.7 END"
    if ranges:
        low = f"lower * CASE WHEN action = 'expand' THEN 1 - (0.05 + 0.03 * chance) * {again} ELSE 1 - (0.05 + 0.02 * chance) * {again} END"
        high = f"upper * CASE WHEN action = 'expand' THEN 1 + (0.05 + 0.03 * chance) * {again} ELSE 1 - (0.05 + 0.02 * chance) * {again} END"
        cap = "(upper - lower) * CASE WHEN action = 'expand' THEN 0.10 ELSE 0.15 END"
    else:
        margin = f"greatest(1.0, least(5.0, abs(value) * 0.05)) * {again}"
        half = "value >= (lower + upper) / 2"
        low = f"CASE WHEN action = 'expand' AND value < lower THEN value - {margin} WHEN action = 'contract' AND {half} THEN greatest(value + {margin}, lower) ELSE lower END"
        high = f"CASE WHEN action = 'expand' AND value > upper THEN value + {margin} WHEN action = 'contract' AND NOT ({half}) THEN least(value - {margin}, upper) ELSE upper END"
        cap = "CASE WHEN action = 'expand' THEN least(50.0, table_rows * 0.05) ELSE least(25.0, table_rows * 0.02) END"
    side = lambda old, new: f"round(greatest({old} + greatest(-({cap}), least({cap}, ({new}) - {old})) * slow, 0), 6)"
    return f"""fold AS (
        SELECT series, -1 AS i, NULL::VARCHAR AS run_id, lower::DOUBLE AS lower, upper::DOUBLE AS upper, '' AS last, []::DOUBLE[] AS lows, []::DOUBLE[] AS ups, false AS swings FROM b
        UNION ALL
        SELECT series, i, run_id, nl, nu, act, list_slice(list_append(lows, nl), -5, -1), list_slice(list_append(ups, nu), -5, -1), swings FROM (
            SELECT *, CASE WHEN action = '' OR tl >= tu THEN '' ELSE action END AS act, CASE WHEN action = '' OR tl >= tu THEN lower ELSE tl END AS nl, CASE WHEN action = '' OR tl >= tu THEN upper ELSE tu END AS nu FROM (
            SELECT *, {side("lower", low)} AS tl, {side("upper", high)} AS tu FROM (
            SELECT *, CASE WHEN swings THEN greatest(0.05, 1 - rate * 0.95) ELSE 1.0 END AS slow,
                CASE WHEN mark = 'normal' AND (value < lower OR value > upper) AND confidence >= CASE WHEN last = 'contract' THEN 0.8 WHEN swings THEN 0.8 ELSE 0.6 END THEN 'expand'
                     WHEN mark = 'outlier' AND value BETWEEN lower AND upper AND confidence >= CASE WHEN last = 'expand' THEN 0.8 WHEN swings THEN 0.9 ELSE 0.7 END THEN 'contract' ELSE '' END AS action FROM (
            SELECT *, len(lows) >= 3 AND ((t1 > 0.4)::INT + (t2 > 0.5)::INT + (t3 > 0.3)::INT >= 2 OR rate > 0.5) AS swings FROM (
            SELECT *, (t1 + t2 + least(t3, 1.0)) / 3 AS rate FROM (
            SELECT *, coalesce(({turns("lows")} + {turns("ups")}) / (2.0 * (len(lows) - 2)), 0) AS t1, coalesce({turns("widths")} / (1.0 * (len(lows) - 2)), 0) AS t2,
                coalesce(list_avg([abs(widths[j] - widths[j - 1]) / widths[j - 1] FOR j IN range(2, len(lows) + 1) IF widths[j - 1] > 0]), 0) AS t3 FROM (
            SELECT fold.series, x.i, x."at" AS run_id, lower, upper, last, lows, ups, [ups[j] - lows[j] FOR j IN range(1, len(lows) + 1)] AS widths, x.value, x.mark, x.confidence, x.chance, x.table_rows
            FROM fold JOIN x ON x.series = fold.series AND x.i = fold.i + 1))))))))"""


@query(f"WITH RECURSIVE {_MARKED}, {_fold_sql(True)} SELECT series, i, run_id, last AS action, lower, upper, swings FROM fold WHERE i >= 0")
def adjusted_ranges_events(spark, sf_dir):
    h = marked_history(spark, sf_dir)
    return adjustments.adjusted(h, start_bounds(h), ranges=True, at_least_0=True)


@query(f"WITH RECURSIVE {_MARKED}, {_fold_sql(False)} SELECT series, i, run_id, last AS action, lower, upper, swings FROM fold WHERE i >= 0")
def adjusted_counts_events(spark, sf_dir):
    h = marked_history(spark, sf_dir)
    return adjustments.adjusted(h, start_bounds(h), ranges=False, at_least_0=True)


@query(
    f"""WITH RECURSIVE {_MARKED}, {_fold_sql(False)}, l AS (SELECT series, lower AS pl, upper AS pu FROM fold QUALIFY row_number() OVER (PARTITION BY series ORDER BY i DESC) = 1),
    y AS (SELECT b.series, lower, upper, pl, pu, CASE WHEN upper > lower THEN abs(upper - lower - (pu - pl)) / (upper - lower) ELSE 0 END AS apart FROM b JOIN l ON l.series = b.series),
    z AS (SELECT *, CASE WHEN apart < 0.2 THEN 0.2 WHEN apart < 0.5 THEN 0.5 ELSE 0.7 END AS share FROM y), w AS (SELECT *, pl + share * (lower - pl) AS nl, pu + share * (upper - pu) AS nu FROM z)
    SELECT series, CASE WHEN nl >= nu THEN lower ELSE floor(round(nl, 9)) END AS lower, CASE WHEN nl >= nu THEN upper ELSE ceil(round(nu, 9)) END AS upper FROM w"""
)
def blended_bounds_events(spark, sf_dir):
    """The data's bounds with those that feedback left."""
    h = marked_history(spark, sf_dir)
    data = start_bounds(h)
    moved = adjustments.adjusted(h, data, ranges=False, at_least_0=True)
    last = moved.groupBy("series").agg(F.max_by(F.struct("lower", "upper"), "i").alias("p"))
    both = data.join(last, "series")
    return both.select("series", adjustments.blended(F.col("lower"), F.col("upper"), F.col("p.lower"), F.col("p.upper")).alias("b")).select("series", "b.lower", "b.upper")


@query(
    f"""WITH {_MARKED}, s AS (SELECT m.series, floor(value / 50) AS value, "at", mark || '_during_' || CASE WHEN value BETWEEN lower AND upper THEN 'ok' ELSE 'high' END AS said FROM m JOIN b ON b.series = m.series WHERE mark IS NOT NULL),
    o AS (SELECT *, lag(said) OVER w AS before, row_number() OVER (PARTITION BY series, value ORDER BY "at" DESC, said DESC) AS back FROM s WINDOW w AS (PARTITION BY series, value ORDER BY "at", said)),
    a AS (SELECT series, value, count(*) AS n, count(*) FILTER (before <> said) AS turns, count(DISTINCT said) FILTER (back <= 3) AS recent FROM o GROUP BY 1, 2)
    SELECT series, value, n, CASE WHEN n > 1 THEN round(turns / (n - 1), 6) ELSE 0 END AS rate, n >= 3 AND (turns / (n - 1) > 0.6 OR recent > 1) AS alternates FROM a"""
)
def alternating_marks_events(spark, sf_dir):
    h = marked_history(spark, sf_dir)
    status = F.when(F.col("value").between(F.col("lower"), F.col("upper")), "Ok").otherwise("High")
    return adjustments.alternation(h.join(start_bounds(h), "series").select("series", F.floor(F.col("value") / 50).cast("double").alias("value"), "at", "mark", status.alias("status")))
