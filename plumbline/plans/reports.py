"""Registered queries of reports, feedback and further threshold models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.operators import history, reports, rules, schema
from plumbline.plans.base import _HISTORY, daily_history, query, t
from plumbline.sources import files

# ---------------------------------------------------------------- reports


@query(
    """SELECT o_orderstatus, count(*) AS total_count, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 100000) AS large,
    count(*) FILTER (o_totalprice <= 100000) AS small FROM orders GROUP BY 1"""
)
def pivot_orders(spark, sf_dir):
    price = F.col("o_totalprice")
    return reports.pivoted(t(spark, sf_dir, "orders"), ["o_orderstatus"], {"urgent": F.col("o_orderpriority") == "1-URGENT", "large": price > 100_000, "small": price <= 100_000})


@query(
    """SELECT l_returnflag, l_linestatus, CAST(2 - grouping(l_returnflag) - grouping(l_linestatus) AS INTEGER) AS level, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def nested_groups_lineitem(spark, sf_dir):
    return reports.nested_groups(t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity").cast("long"))


@query(
    """WITH r AS (SELECT o_custkey AS series, o_orderkey AS run_id, o_orderdate AS began, max(l_shipdate) AS ended, count(*) AS volume FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
    k AS (SELECT *, lead(began) OVER w AS before, row_number() OVER w AS rn FROM r WINDOW w AS (PARTITION BY series ORDER BY began DESC, run_id DESC))
    SELECT series, run_id, CAST(epoch(ended) - epoch(began) AS BIGINT) AS duration, CAST(epoch(began) - epoch(before) AS BIGINT) AS delay, volume FROM k WHERE rn = 1"""
)
def run_measures_orders(spark, sf_dir):
    """An order as a run of its customer's pipeline, which ends with the last shipment."""
    shipped = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"), F.count("*").alias("volume"))
    runs = t(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return reports.run_measures(runs.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), "ended", "volume"))


_KINDS = (("today", 1), ("yesterday", 1), ("days", 30), ("months", 6))


@query(
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT DATE '1997-06-15' AS n)
    SELECT count(*) FILTER (d = n) AS today, count(*) FILTER (d = n - 1) AS yesterday, count(*) FILTER (d > n - 30 AND d <= n) AS days, count(*) FILTER (d > n - INTERVAL 6 MONTH AND d <= n) AS months FROM d, x"""
)
def date_windows_orders(spark, sf_dir):
    now = F.lit("1997-06-15").cast("date")
    return t(spark, sf_dir, "orders").agg(*(F.count_if(reports.in_window(F.col("o_orderdate"), k, now, n)).alias(k) for k, n in _KINDS))


@query(
    """WITH c AS (SELECT n_regionkey, n_name, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    s AS (SELECT n_regionkey, count(*) AS n, CAST(sum(CAST(round(score * 10000) AS BIGINT)) AS BIGINT) AS s FROM c GROUP BY 1)
    SELECT n_regionkey, n AS n_children, ((2 * s + 10 * n) // (20 * n)) / 1000.0 AS score FROM s"""
)
def parent_scores_region(spark, sf_dir):
    joined = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.parent_scores(rules.grouped_scores(joined, ["n_regionkey", "n_name"], F.col("c_acctbal") > 0), "n_regionkey")


@query(
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM (SELECT c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE rn = 1"""
)
def latest_order_of_customer(spark, sf_dir):
    return reports.with_latest(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT n_name, k.invalid FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS invalid FROM customer WHERE c_acctbal < -950 GROUP BY 1) k ON c_nationkey = n_nationkey")
def measures_of_nation(spark, sf_dir):
    """Every nation with its measure, null where none was taken."""
    found = t(spark, sf_dir, "customer").filter("c_acctbal < -950").groupBy("c_nationkey").agg(F.count("*").alias("invalid"))
    return t(spark, sf_dir, "nation").join(found, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", "invalid")


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS number FROM orders")
def numbered_orders(spark, sf_dir):
    return reports.numbered(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "number").select("o_orderkey", "o_custkey", "number")


@query(f"WITH {_HISTORY} SELECT series, \"at\" AS run_id, value, CAST(rank() OVER (PARTITION BY \"at\" ORDER BY value DESC) AS INTEGER) AS place FROM h")
def ranks_in_run_events(spark, sf_dir):
    return reports.ranked(daily_history(spark, sf_dir), ["run_id"], [F.desc("value")], "place").select("series", "run_id", "value", "place")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50")
def sample_customer(spark, sf_dir):
    """A seeded sample of 50 rows; the limit is the operator."""
    return reports.sample(t(spark, sf_dir, "customer"), "c_custkey", 50, 42).select("c_custkey", "c_name")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def nations_in_use(spark, sf_dir):
    return reports.distinct_union(*(t(spark, sf_dir, n).select(F.col(f"{n[0]}_nationkey").alias("nationkey")) for n in ("customer", "supplier")))


_SHAPES = ("customer", "orders", "lineitem", "documents")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, (SELECT count(*) FROM (DESCRIBE {n})) AS column_count" for n in _SHAPES))
def table_shapes(spark, sf_dir):
    return reports.shapes(spark, {n: t(spark, sf_dir, n) for n in _SHAPES})


# ---------------------------------------------------------------- measures of values


@query(
    """SELECT 'positive' AS kind, count(*) AS total_count, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS valid_count, round(100.0 * count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*), 4) AS score FROM orders
    UNION ALL SELECT 'negative', count(*), count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), round(100.0 * (count(*) - count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))) / count(*), 4) FROM orders"""
)
def enum_scores_orders(spark, sf_dir):
    o, valid = t(spark, sf_dir, "orders"), ["1-URGENT", "2-HIGH"]
    parts = [rules.enum_score(o, "o_orderpriority", valid, positive).select(F.lit(k).alias("kind"), "*") for k, positive in (("positive", True), ("negative", False))]
    return parts[0].unionByName(parts[1])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{m}' AS measure, count(*) AS total_count, count(*) FILTER ({x}) AS outside, round(100.0 * (count(*) - count(*) FILTER ({x})) / count(*), 4) AS score FROM customer"
        for c, m, x in (("c_mktsegment", "length_range", "length(c_mktsegment) NOT BETWEEN 9 AND 10"), ("c_acctbal", "value_range", "c_acctbal NOT BETWEEN -500 AND 9000"))
    )
)
def range_measures_customer(spark, sf_dir):
    return rules.outside_range(t(spark, sf_dir, "customer"), {"c_mktsegment": (9, 10)}, {"c_acctbal": (-500, 9000)})


@query("SELECT CASE WHEN CAST(c_acctbal AS DECIMAL(18, 2)) < 0 THEN 'negative' ELSE 'positive' END AS sign, count(*) AS n FROM customer GROUP BY 1")
def signs_acctbal(spark, sf_dir):
    """Signs by pattern: values are counted by pattern first, so the expression runs once a pattern."""
    found = t(spark, sf_dir, "customer").groupBy(patterns.long_pattern(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("p")).agg(F.count("*").alias("n"))
    return found.groupBy(patterns.sign(F.col("p")).alias("sign")).agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderkey * 7 % 100 AS INTEGER) AS number, CAST(o_orderdate AS DATE) AS day, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(NULL AS INTEGER) AS word FROM orders")
def safe_casts_orders(spark, sf_dir):
    """Texts cast safely: padded numbers, days in two notations, words."""
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    texts = {"number": (F.concat(F.lit("  "), (F.col("o_orderkey") * 7 % 100).cast("string"), F.lit(" ")), "int"), "day": (day, "date"), "priority": (F.substring("o_orderpriority", 1, 1), "int"), "word": (F.col("o_orderpriority"), "int")}
    return t(spark, sf_dir, "orders").select("o_orderkey", *(files.safe_cast(c, k).alias(n) for n, (c, k) in texts.items()))


@query("SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS item FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'")
def json_items_orders(spark, sf_dir):
    """A path through an array of objects; rows whose array is empty stay."""
    c = F.col("o_custkey")
    items = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit('{"items":[{"id":'), c, F.lit('},{"id":'), c + 1, F.lit("}]}"))).otherwise('{"items":[]}')
    return schema.flattened(t(spark, sf_dir, "orders").select("o_orderkey", items.alias("j")), "j", "items.[].id", "long", "item").select("o_orderkey", "item")


# ---------------------------------------------------------------- history, thresholds, feedback


@query(f"WITH {_HISTORY}, m AS (SELECT *, max(CAST(\"at\" AS DATE)) OVER (PARTITION BY series) AS latest FROM h) SELECT series, \"at\", value, \"at\" AS run_id FROM m WHERE CAST(\"at\" AS DATE) > latest - 10")
def recent_events(spark, sf_dir):
    return history.recent(daily_history(spark, sf_dir), days=10)


@query(f"WITH {_HISTORY} SELECT series, '[' || string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR) || '.0', ',' ORDER BY \"at\") || ']' AS history FROM h GROUP BY 1")
def collected_events(spark, sf_dir):
    return history.collected(daily_history(spark, sf_dir))


@query(
    f"""WITH {_HISTORY}, s AS (SELECT series, avg(value) AS m, stddev_pop(value) AS s, median(value) AS middle FROM h GROUP BY 1)
    SELECT series, "at", "at" AS run_id, CASE WHEN abs(value - m) > 2 * s THEN middle ELSE value END AS value FROM h JOIN s USING (series)"""
)
def without_outliers_events(spark, sf_dir):
    return history.without_outliers(daily_history(spark, sf_dir))


@query(
    f"""WITH {_HISTORY}, s AS (SELECT series, median(value) AS middle FROM h GROUP BY 1)
    SELECT series, "at", "at" AS run_id, CASE WHEN CAST(value AS BIGINT) % 5 = 0 THEN middle WHEN CAST(value AS BIGINT) % 5 = 1 THEN (CASE WHEN value <= middle THEN value * 0.5 ELSE value * 1.5 END) ELSE value END AS value FROM h JOIN s USING (series)"""
)
def feedback_events(spark, sf_dir):
    """Values that 5 divides are marked as wrong, those one beyond as right."""
    h = daily_history(spark, sf_dir)
    rest = F.col("value").cast("long") % 5
    return history.weighed_by_feedback(h, h.filter(rest < 2).select("series", "value", (rest == 1).alias("accepted")).distinct())


@query(
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0.15 WHEN o_orderkey % 7 = 0 THEN 1.0 WHEN o_orderkey % 20 <= 2 THEN 0.2 WHEN o_orderkey % 20 <= 5 THEN 0.4 WHEN o_orderkey % 20 <= 15 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS share,
    CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'O' THEN 'expand' WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'O' THEN 'contract' ELSE 'conflicted' END AS action FROM orders"""
)
def feedback_priority_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    share = history.data_share(k % 10 == 0, F.when(k % 7 != 0, k % 20))
    action = history.feedback_action(F.when(k % 2 == 0, "normal").otherwise("outlier"), F.when(F.col("o_orderstatus") == "O", "Ok").otherwise("High"))
    return t(spark, sf_dir, "orders").select("o_orderkey", share.cast("double").alias("share"), action.alias("action"))


@query(
    f"""WITH {_HISTORY}, r AS (SELECT series, min("at") AS lo, max("at") AS hi FROM h GROUP BY 1), x AS (SELECT series, hi, CASE WHEN series < 'm' THEN strftime(CAST(lo AS DATE) + 5, '%Y-%m-%d') WHEN series < 's' THEN '9999-12-31' END AS reset_at FROM r)
    SELECT series, "at", value, "at" AS run_id FROM h JOIN x USING (series) WHERE reset_at IS NULL OR "at" >= least(reset_at, hi)"""
)
def since_reset_events(spark, sf_dir):
    h = daily_history(spark, sf_dir)
    at = F.when(F.col("series") < "m", F.date_add(F.to_date(F.min("at")), 5).cast("string")).when(F.col("series") < "s", F.lit("9999-12-31"))
    return history.since_reset(h, h.groupBy("series").agg(at.alias("reset_at")).filter("reset_at is not null"))


@query(
    f"""WITH {_HISTORY}, a AS (SELECT *, value > avg(value) OVER (PARTITION BY series) AS raised FROM h),
    l AS (SELECT *, last_value(CASE WHEN raised THEN "at" END IGNORE NULLS) OVER (PARTITION BY series ORDER BY "at" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS linked_run FROM a)
    SELECT series, "at" AS run_id, linked_run FROM l WHERE raised"""
)
def linked_alerts_events(spark, sf_dir):
    h = daily_history(spark, sf_dir)
    means = h.groupBy("series").agg(F.avg("value").alias("m"))
    return history.linked_alerts(h.join(means, "series").withColumn("raised", F.col("value") > F.col("m")), 3).select("series", "run_id", "linked_run")


@query(
    f"""WITH {_HISTORY}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY "at") AS DOUBLE) AS i FROM h)
    SELECT series, count(*) AS n, round(regr_slope(value, i), 3) AS slope, round(regr_intercept(value, i) + regr_slope(value, i) * (count(*) + 1), 3) AS forecast FROM x GROUP BY 1"""
)
def linear_forecast_events(spark, sf_dir):
    return history.linear_forecast(daily_history(spark, sf_dir))


@query(
    f"""WITH {_HISTORY}, x AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY "at") AS p FROM h)
    SELECT series, round(regr_slope(value, p), 3) AS slope, round(regr_intercept(value, p) + regr_slope(value, p) * arg_max(value, "at"), 3) AS forecast FROM x GROUP BY 1"""
)
def autoregression_events(spark, sf_dir):
    return history.autoregression(daily_history(spark, sf_dir))


@query(
    f"""WITH {_HISTORY}, x AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY "at") AS p FROM h),
    f AS (SELECT series, count(value) AS n, regr_intercept(value, p) + regr_slope(value, p) * arg_max(value, "at") AS f, sqrt(greatest(regr_syy(value, p) - pow(regr_slope(value, p), 2) * regr_sxx(value, p), 0) / regr_count(value, p)) AS e FROM x GROUP BY 1)
    SELECT series, n, round(f, 2) AS forecast, round(greatest(f - 1.96 * e, 0), 2) AS lower, round(f + 1.96 * e, 2) AS upper FROM f"""
)
def autoregression_bounds_events(spark, sf_dir):
    return history.autoregression_bounds(daily_history(spark, sf_dir))
