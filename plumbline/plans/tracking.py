"""Registered queries of groups with limits, learned ranges, bounds from two sources, versions and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import history, rules, tracking
from plumbline.plans.adjustments import _MARKED, _fold_sql, marked_history, start_bounds
from plumbline.plans.base import query, t

_GROUPED = """g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(o_totalprice) AS a, max(o_totalprice) AS m, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _measured(spark, sf_dir):
    joined = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return tracking.grouped_measures(joined, ["c_mktsegment", "c_nationkey"], [("avg", "o_totalprice"), ("max", "o_totalprice"), ("count_distinct", "o_custkey")])


@query(
    f"""WITH {_GROUPED} SELECT c_mktsegment, c_nationkey, 'avg_o_totalprice' AS measure, round(a, 4) AS value, n FROM g UNION ALL SELECT c_mktsegment, c_nationkey, 'max_o_totalprice', round(m, 4), n FROM g
    UNION ALL SELECT c_mktsegment, c_nationkey, 'count_distinct_o_custkey', c, n FROM g"""
)
def grouped_measures_orders(spark, sf_dir):
    return _measured(spark, sf_dir).withColumn("value", F.round("value", 4))


@query(
    f"""WITH {_GROUPED}, x AS (
        SELECT c_mktsegment, c_nationkey, 'avg_o_totalprice' AS measure, CASE WHEN a < 180000 THEN 'Low' END AS p FROM g UNION ALL SELECT c_mktsegment, c_nationkey, 'avg_o_totalprice', CASE WHEN a > 260000 THEN 'Medium' END FROM g
        UNION ALL SELECT c_mktsegment, c_nationkey, 'max_o_totalprice', CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 3 THEN CASE WHEN m > 100 THEN 'High' END WHEN m > 499000 THEN 'Medium' END FROM g),
    y AS (SELECT * FROM x WHERE p IS NOT NULL)
    SELECT c_mktsegment, c_nationkey, CASE min(CASE p WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS status,
    '[' || string_agg('{{"measure":"' || measure || '","priority":"' || p || '"}}', ',' ORDER BY measure, p) || ']' AS met FROM y GROUP BY 1, 2"""
)
def grouped_alerts_orders(spark, sf_dir):
    limits = spark.createDataFrame(
        [(None, None, "avg_o_totalprice", "Low", 180_000.0, None), (None, None, "avg_o_totalprice", "Medium", None, 260_000.0), (None, None, "max_o_totalprice", "Medium", None, 499_000.0), ("BUILDING", 3, "max_o_totalprice", "High", None, 100.0)],
        "c_mktsegment string, c_nationkey int, measure string, priority string, lower double, upper double",
    )
    return tracking.grouped_alerts(_measured(spark, sf_dir), ["c_mktsegment", "c_nationkey"], limits)


@query(
    """WITH d AS (SELECT strftime(o_orderdate, '%Y') AS y, min(o_totalprice) AS pl, max(o_totalprice) AS ph, CAST(min(length(o_orderpriority)) AS DOUBLE) AS ll, CAST(max(length(o_orderpriority)) AS DOUBLE) AS lh FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
    e AS (SELECT 'price' AS measure, min(pl) AS low, max(ph) AS high, count(*) AS runs FROM d UNION ALL SELECT 'priority_length', min(ll), max(lh), count(*) FROM d),
    r AS (SELECT measure, round(low - 0.05 * CASE WHEN high > low THEN high - low ELSE abs(high) END, 6) AS lower, round(high + 0.05 * CASE WHEN high > low THEN high - low ELSE abs(high) END, 6) AS upper FROM e WHERE runs >= 3),
    n AS (SELECT o_totalprice AS price, length(o_orderpriority) AS len FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
    s AS (SELECT measure, (SELECT count(*) FROM n) AS total_count, CASE measure WHEN 'price' THEN (SELECT count(*) FROM n WHERE price < lower OR price > upper) ELSE (SELECT count(*) FROM n WHERE len < lower OR len > upper) END AS outside FROM r)
    SELECT measure, total_count, outside, round(100.0 * (total_count - outside) / total_count, 4) AS score FROM s"""
)
def learned_ranges_orders(spark, sf_dir):
    """Ranges of prices and lengths learned by year, and the later orders outside of them."""
    o = t(spark, sf_dir, "orders")
    past, later = o.filter("o_orderdate < timestamp'1998-01-01'"), o.filter("o_orderdate >= timestamp'1998-01-01'")
    year = F.date_format("o_orderdate", "yyyy").alias("at")
    measures = {"price": F.col("o_totalprice"), "priority_length": F.length("o_orderpriority")}
    extremes = None
    for m, c in measures.items():
        part = past.groupBy(year).agg(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).withColumn("measure", F.lit(m))
        extremes = part if extremes is None else extremes.unionByName(part)
    return tracking.outside_learned(later, measures, tracking.learned_ranges(extremes))


@query(
    f"""WITH RECURSIVE {_MARKED}, {_fold_sql(False)}, l AS (SELECT series, lower AS fl, upper AS fu FROM fold QUALIFY row_number() OVER (PARTITION BY series ORDER BY i DESC) = 1),
    k AS (SELECT series, max(i) AS n, max(i) FILTER (mark IS NOT NULL) AS marked FROM x GROUP BY 1),
    p AS (SELECT b.series, lower, upper, fl, fu, CAST(CASE WHEN marked = n THEN 0.15 WHEN marked IS NULL THEN 1.0 WHEN n - marked <= 2 THEN 0.2 WHEN n - marked <= 5 THEN 0.4 WHEN n - marked <= 15 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS share
          FROM b JOIN l ON l.series = b.series JOIN k ON k.series = b.series),
    q AS (SELECT *, floor(round(share * lower + (1 - share) * fl, 9)) AS pl, ceil(round(share * upper + (1 - share) * fu, 9)) AS pu FROM p)
    SELECT series, share, CASE WHEN pl >= pu THEN lower ELSE pl END AS lower, CASE WHEN pl >= pu THEN upper ELSE pu END AS upper,
    abs(lower - fl) <= 0.2 * (upper - lower) AND abs(upper - fu) <= 0.2 * (upper - lower) AS aligned,
    (fu - fl > 2.5 * (upper - lower))::INT + (abs(fl - lower) > 1.5 * (upper - lower))::INT + (abs(fu - upper) > 1.5 * (upper - lower))::INT >= 2 AS contaminated FROM q"""
)
def prioritised_bounds_events(spark, sf_dir):
    """The data's bounds and those that feedback left, by how long ago feedback was."""
    from plumbline.operators import adjustments

    h = marked_history(spark, sf_dir)
    data = start_bounds(h)
    moved = adjustments.adjusted(h, data, ranges=False, at_least_0=True)
    last = moved.groupBy("series").agg(F.max_by(F.struct("lower", "upper"), "i").alias("f"), F.max("i").alias("n"))
    marked = moved.select("series", "i", "run_id").join(h.filter("mark is not null").select("series", "run_id"), ["series", "run_id"]).groupBy("series").agg(F.max("i").alias("marked"))
    both = data.join(last, "series").join(marked, "series", "left")
    share = history.data_share(F.coalesce(F.col("marked") == F.col("n"), F.lit(False)), F.col("n") - F.col("marked"))
    sides = (F.col("lower"), F.col("upper")), (F.col("f.lower"), F.col("f.upper"))
    both = both.select(
        "series", share.alias("share"), tracking.prioritised(share, *sides).alias("b"), tracking.aligned(*sides[0], *sides[1], ranges=False).alias("aligned"), tracking.contaminated(*sides[1], *sides[0]).alias("contaminated")
    )
    return both.select("series", "share", "b.lower", "b.upper", "aligned", "contaminated")


@query(
    """WITH m AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS "at", event_type AS c FROM events WHERE value > 120), d AS (SELECT "at", row_number() OVER (ORDER BY "at") AS i FROM (SELECT DISTINCT "at" FROM m)),
    n AS (SELECT d.i, count(*) FILTER (o.c IS NULL) AS added FROM d JOIN m ON m."at" = d."at" LEFT JOIN d p ON p.i = d.i - 1 LEFT JOIN m o ON o."at" = p."at" AND o.c = m.c GROUP BY 1),
    g AS (SELECT d.i, count(m.c) FILTER (o.c IS NULL) AS removed FROM d LEFT JOIN d p ON p.i = d.i - 1 LEFT JOIN m ON m."at" = p."at" LEFT JOIN m o ON o."at" = d."at" AND o.c = m.c GROUP BY 1),
    x AS (SELECT d."at", d.i, CASE WHEN d.i = 1 THEN 0 ELSE added END AS added, CASE WHEN d.i = 1 THEN 0 ELSE removed END AS removed FROM d JOIN n ON n.i = d.i JOIN g ON g.i = d.i),
    y AS (SELECT *, sum((removed > 0)::INT) OVER (ORDER BY i) AS major FROM x)
    SELECT 'events' AS asset, "at", CAST(added AS INTEGER) AS added, CAST(removed AS INTEGER) AS removed, 0 AS retyped,
    CAST(1 + major AS VARCHAR) || '.' || CAST(sum((added > 0 AND removed = 0)::INT) OVER (PARTITION BY major ORDER BY i) AS VARCHAR) AS version FROM y"""
)
def versions_events(spark, sf_dir):
    """Each day's kinds of large events as the columns of a snapshot; kinds that are missing raise the version."""
    e = t(spark, sf_dir, "events").filter("value > 120")
    snapshots = e.select(F.lit("events").alias("asset"), F.date_format("ts", "yyyy-MM-dd").alias("at"), F.col("event_type").alias("column_name"), F.lit("string").alias("datatype")).distinct()
    return tracking.versions(snapshots, most=10_000)


@query(
    """WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS "at", unnest([{'c': 'o_custkey', 'v': CAST(o_custkey AS VARCHAR)}, {'c': 'o_orderkey', 'v': CAST(o_orderkey AS VARCHAR)}, {'c': 'urgent', 'v': CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END}]) AS x FROM orders),
    n AS (SELECT "at", x.c AS c, x.v AS v, count(*) AS n FROM v GROUP BY 1, 2, 3), o AS (SELECT "at", c, count(*) FILTER (v IS NULL) = 0 AS not_null, coalesce(max(n) FILTER (v IS NOT NULL), 1) = 1 AS uniq FROM n GROUP BY 1, 2),
    l AS (SELECT c, "at", 'not_null' AS k, not_null AS h FROM o UNION ALL SELECT c, "at", 'unique', uniq FROM o), w AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY c, k ORDER BY "at"), false) AS b FROM l)
    SELECT c AS column_name, "at", k AS "constraint", CASE WHEN h THEN 'created' ELSE 'deactivated' END AS change FROM w WHERE h <> b"""
)
def constraint_changes_orders(spark, sf_dir):
    """What holds of columns month by month."""
    o = t(spark, sf_dir, "orders").withColumn("urgent", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")))
    return tracking.constraint_changes(tracking.observed_constraints(o, F.date_format("o_orderdate", "yyyy-MM"), ["o_custkey", "o_orderkey", "urgent"]))


@query(
    """WITH f AS (SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT o_totalprice <= 400000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT o_orderstatus <> 'P'),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY o_orderkey) AS number, count(*) OVER (PARTITION BY rule) AS total_failed FROM f)
    SELECT 'run 1' AS run_id, 'orders' AS asset, o_orderkey, rule, CAST(number AS INTEGER) AS number, total_failed FROM n WHERE number <= 100"""
)
def exported_failures_orders(spark, sf_dir):
    failed = rules.failed_rows(t(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") <= 400_000, "status": F.col("o_orderstatus") != "P"}, ["o_orderkey"]).select("o_orderkey", "rule")
    return tracking.exported_failures(failed, {"run_id": "run 1", "asset": "orders"}, 100, ["o_orderkey"])
