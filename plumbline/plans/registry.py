"""Registered queries and their oracle SQL (for DuckDB, over the same tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.operators import distributions, health, history, records, rules, schema
from plumbline.plans.base import _HISTORY, daily_history, oracle_sql, queries, query, t  # noqa: F401
from plumbline.sources import files
from plumbline.streaming import behaviour

# ---------------------------------------------------------------- health and statistics


def _health_sql(table: str, columns: dict[str, str]) -> str:
    """One SELECT per column; kinds are n (number), s (text), o (other)."""
    out = []
    for c, k in columns.items():
        text = lambda x: x if k == "s" else "CAST(NULL AS BIGINT)"  # noqa: B023, E731
        empty = f"(count(*) FILTER ({c} IS NULL)" + (f" + count(*) FILTER ({c} = '') + count(*) FILTER (regexp_full_match({c}, ' +'))" if k == "s" else "") + ")"
        out.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count, {text(f'''count(*) FILTER ({c} = '')''')} AS blank_count, "
            f"{text(f'''count(*) FILTER (regexp_full_match({c}, ' +'))''')} AS space_count, {f'count(*) FILTER ({c} = 0)' if k == 'n' else 'CAST(NULL AS BIGINT)'} AS zero_values, "
            f"count(DISTINCT {c}) AS distinct_count, {text(f'min(length({c}))')} AS min_length, {text(f'max(length({c}))')} AS max_length, "
            f"count(*) - {empty} AS non_empty, count(*) - count(DISTINCT {c}) AS duplicate_count, round(100.0 * (count(*) - {empty}) / count(*), 4) AS score FROM {table}"
        )
    return " UNION ALL ".join(out)


_LINEITEM = dict.fromkeys("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split(), "n") | {"l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "o"}


@query(_health_sql("lineitem", _LINEITEM))
def health_lineitem(spark, sf_dir):
    return health.health_profile(t(spark, sf_dir, "lineitem"))


@query(_health_sql("customer", {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}))
def health_customer(spark, sf_dir):
    return health.health_profile(t(spark, sf_dir, "customer"))


@query(_health_sql("documents", {"doc_id": "n", "text": "s", "lang": "s", "source": "s", "n_chars": "n"}))
def health_documents(spark, sf_dir):
    return health.health_profile(t(spark, sf_dir, "documents"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_lineitem(spark, sf_dir)


def _statistics_sql(table: str, columns: list[str]) -> str:
    out = []
    for c in columns:
        m = lambda k: f"avg(pow({c} - (SELECT avg({c}) FROM {table}), {k}))"  # noqa: B023, E731
        out.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, round(CAST(max({c}) - min({c}) AS DOUBLE), 3) AS value_range, round(CAST(sum({c}) AS DOUBLE), 3) AS total, round(avg({c}), 3) AS mean, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 3) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 3) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 3) AS q3, "
            f"round(stddev_samp({c}), 3) AS standard_deviation, round(var_samp({c}), 3) AS variance, round(1.96 * stddev_samp({c}) / sqrt(count({c})), 3) AS margin_of_error, "
            f"round({m(3)} / pow(var_pop({c}), 1.5), 3) AS skewness, round(kurtosis_pop({c}), 3) AS kurtosis FROM {table}"
        )
    return " UNION ALL ".join(out)


@query(_statistics_sql("lineitem", ["l_quantity", "l_discount", "l_tax"]))
def statistics_lineitem(spark, sf_dir):
    return health.statistics(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query(_statistics_sql("part", ["p_size", "p_retailprice"]))
def statistics_part(spark, sf_dir):
    return health.statistics(t(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count, count(*) FILTER (n > 1) AS duplicated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)")
def duplicates_lineitem(spark, sf_dir):
    return health.table_duplicates(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT CAST(epoch(TIMESTAMP '2025-01-01' - date_trunc('second', max(ts))) AS BIGINT) AS freshness FROM events")
def freshness_events(spark, sf_dir):
    return health.freshness(t(spark, sf_dir, "events"), "ts", F.lit("2025-01-01 00:00:00").cast("timestamp")).select("freshness")


# ---------------------------------------------------------------- distributions and patterns


def _pattern_sql(table: str, column: str, short: bool = True) -> str:
    plus = "+" if short else ""
    steps = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[A-Za-z]{plus}', 'A', 'g'), '[0-9]{plus}', 'N', 'g'), '[''\"]{plus}', 'Q', 'g'), ' {plus.strip()}', 'S', 'g')"
    inner = f"SELECT CASE WHEN v IS NULL THEN 'NULL' WHEN v = '' THEN 'E' ELSE {steps} END AS pattern, v FROM (SELECT CAST({column} AS VARCHAR) AS v FROM {table})"
    more = (
        """, CASE WHEN regexp_matches(pattern, '^[S].*[^S]+.*[^S]+.*[S]$') THEN 'outer' WHEN regexp_matches(pattern, '^[^S].*[S]+.*[^S]$') THEN 'inner'
        WHEN regexp_matches(pattern, '^[^S].*[S]+$') THEN 'trailing' WHEN regexp_matches(pattern, '^[S]+.*[^S]$') THEN 'leading' ELSE 'no_space' END AS space_class,
        CASE pattern WHEN 'NULL' THEN 'null' WHEN 'E' THEN 'empty' WHEN 'S' THEN 'space' WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'digit' ELSE
        CASE WHEN regexp_full_match(pattern, '[AN]+') THEN 'alphanumeric' WHEN regexp_full_match(pattern, '[ANS]+') THEN 'with_space' ELSE 'special' END END AS character_class"""
        if short
        else ""
    )
    return f"SELECT pattern, count(*) AS value_count, count(DISTINCT v) AS distinct_values{more} FROM ({inner}) GROUP BY pattern"


@query(_pattern_sql("part", "p_name"))
def short_patterns_part_name(spark, sf_dir):
    return distributions.pattern_distribution(t(spark, sf_dir, "part"), "p_name")


def _contained_sql(table: str, column: str) -> str:
    mixed = "pattern NOT IN ('NULL', 'E', 'S', 'A', 'N')"
    tests = {
        "null": "pattern = 'NULL'", "empty": "pattern = 'E'", "space": "pattern = 'S'", "white_space": f"pattern = 'S' OR {mixed} AND contains(pattern, 'S')", "alphabet": f"pattern = 'A' OR {mixed} AND contains(pattern, 'A')",
        "digits": f"pattern = 'N' OR {mixed} AND contains(pattern, 'N')", "alphanumeric": f"{mixed} AND regexp_full_match(pattern, '[AN]+')", "special": f"{mixed} AND regexp_replace(pattern, '[ANS]', '', 'g') <> ''",
    }
    return f"WITH d AS ({_pattern_sql(table, column)}) SELECT " + ", ".join(f"""CAST(coalesce(sum(value_count) FILTER ({c}), 0) AS BIGINT) AS "{k}\"""" for k, c in tests.items()) + " FROM d"


@query(_contained_sql("pages", "url"))
def contained_classes_page_url(spark, sf_dir):
    return distributions.contained_classes(t(spark, sf_dir, "pages"), "url")


@query(_contained_sql("events", "props"))
def contained_classes_event_props(spark, sf_dir):
    return distributions.contained_classes(t(spark, sf_dir, "events"), "props")


@query(_pattern_sql("pages", "url"))
def short_patterns_page_url(spark, sf_dir):
    return distributions.pattern_distribution(t(spark, sf_dir, "pages"), "url")


@query(_pattern_sql("customer", "c_name", short=False))
def long_patterns_customer_name(spark, sf_dir):
    return distributions.pattern_distribution(t(spark, sf_dir, "customer"), "c_name", short=False)


@query("SELECT CAST(length(text) AS BIGINT) AS length_value, count(*) AS value_count FROM documents GROUP BY 1")
def lengths_document_text(spark, sf_dir):
    return distributions.length_distribution(t(spark, sf_dir, "documents"), "text")


@query("SELECT CAST(p_brand AS VARCHAR) AS enum_value, count(*) AS value_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 25")
def top_values_part_brand(spark, sf_dir):
    return distributions.top_values(t(spark, sf_dir, "part"), "p_brand")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, d AS distinct_count, l AS max_length, k AS n_lengths,
        CASE WHEN d > 0 AND d <= 10000 AND 100.0 * d <= 25.0 * n THEN 'enum' WHEN l <= 70 AND k - 2 <= 20 THEN 'long_pattern' WHEN k - 2 <= 40 THEN 'short_pattern' ELSE 'length' END AS strategy
        FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS d, coalesce(max(length({c})), 0) AS l, count(DISTINCT length({c})) AS k FROM documents)"""
        for c in ("text", "lang", "source")
    )
)
def strategy_documents(spark, sf_dir):
    return distributions.profile_strategy(t(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query(
    """WITH c AS (SELECT event_type AS enum_value, count(*) AS value_count FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
    p AS (SELECT DISTINCT event_type AS old FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'error')
    SELECT enum_value, value_count, old IS NULL AS is_new, coalesce(enum_value IS NOT NULL AND trim(enum_value) <> '' AND enum_value >= 'd' AND enum_value <= 'w', false) AS is_valid FROM c LEFT JOIN p ON enum_value IS NOT DISTINCT FROM old"""
)
def validity_event_types(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    border = F.lit("2024-01-16").cast("timestamp_ntz")
    values = lambda d: distributions.distribution(d, F.col("event_type"), "enum_value")
    return distributions.validity(values(e.filter(F.col("ts") >= border)), values(e.filter((F.col("ts") < border) & (F.col("event_type") != "error"))), "d", "w")


# ---------------------------------------------------------------- rules

_ORDER_RULES = {
    "price_in_range": {"column": "o_totalprice", "op": "between", "value": (1000, 400_000)},
    "status_known": {"column": "o_orderstatus", "op": "in", "value": ["F", "O"]},
    "urgent_or_dear": {"any": [{"column": "o_orderpriority", "op": "starts", "value": "1"}, {"all": [{"column": "o_totalprice", "op": "gt", "value": 200_000}, {"not": {"column": "o_orderstatus", "op": "eq", "value": "P"}}]}]},
    "priority_form": {"column": "o_orderpriority", "op": "matches", "value": "^[1-5]-[A-Z ]+$"},
}
_ORDER_SQL = {
    "price_in_range": "o_totalprice BETWEEN 1000 AND 400000",
    "status_known": "o_orderstatus IN ('F', 'O')",
    "urgent_or_dear": "(starts_with(o_orderpriority, '1') OR (o_totalprice > 200000 AND NOT o_orderstatus = 'P'))",
    "priority_form": "regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')",
}


def _order_rules():
    return {k: rules.rule(v) for k, v in _ORDER_RULES.items()}


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS rule, count(*) AS total_count, count(*) FILTER ({p}) AS valid_count, count(*) - count(*) FILTER ({p}) AS invalid_count, round(least(100.0, 100.0 * count(*) FILTER ({p}) / count(*) * {80 if k == 'status_known' else 100} / 100), 4) AS score FROM orders"
        for k, p in _ORDER_SQL.items()
    )
)
def rules_orders(spark, sf_dir):
    return rules.measured(t(spark, sf_dir, "orders"), _order_rules(), {"status_known": 80})


@query(" UNION ALL ".join(f"SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS identifier_key, '{k}' AS rule FROM orders WHERE NOT {p}" for k, p in _ORDER_SQL.items()))
def failed_rows_orders(spark, sf_dir):
    return rules.failed_rows(t(spark, sf_dir, "orders"), _order_rules(), ["o_orderkey"])


@query(
    "SELECT identifier_key, count(*) AS n_rules, '[' || string_agg('\"' || rule || '\"', ',' ORDER BY rule) || ']' AS rules FROM ("
    + " UNION ALL ".join(f"SELECT md5(CAST(o_orderkey AS VARCHAR)) AS identifier_key, '{k}' AS rule FROM orders WHERE NOT {p}" for k, p in _ORDER_SQL.items())
    + ") GROUP BY 1"
)
def failed_summary_orders(spark, sf_dir):
    return rules.failed_summary(failed_rows_orders(spark, sf_dir))


@query(
    "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS identifier_key, 'status_known' AS rule FROM orders WHERE NOT o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 50000)"
)
def failed_without_accepted(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    accepted = o.filter("o_totalprice < 50000").select(rules.identifier(["o_orderkey"]).alias("identifier_key"))
    found = rules.failed_rows(o, {"status_known": _order_rules()["status_known"]}, ["o_orderkey"])
    return rules.without_accepted(found, accepted).select("o_orderkey", "identifier_key", "rule")


@query(
    """SELECT count(*) AS total_count, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS valid_count,
    count(*) - count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS invalid_count FROM orders"""
)
def lookup_order_customer(spark, sf_dir):
    return rules.lookup(t(spark, sf_dir, "orders"), "o_custkey", t(spark, sf_dir, "customer").filter("c_acctbal > 0"), "c_custkey")


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000), b AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'O')
    SELECT (SELECT count(*) FROM a SEMI JOIN b USING (o_orderkey, o_custkey)) AS source_matched, (SELECT count(*) FROM a ANTI JOIN b USING (o_orderkey, o_custkey)) AS source_unmatched,
    (SELECT count(*) FROM b SEMI JOIN a USING (o_orderkey, o_custkey)) AS target_matched, (SELECT count(*) FROM b ANTI JOIN a USING (o_orderkey, o_custkey)) AS target_unmatched"""
)
def compare_order_sets(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    keys = ["o_orderkey", "o_custkey"]
    return rules.compare_keys(o.filter("o_totalprice > 100000"), o.filter("o_orderstatus <> 'O'"), keys, keys)


@query(
    """SELECT n_name, count(*) AS total_count, count(*) FILTER (c_acctbal > 0) AS valid_count, round(least(100.0, 100.0 * count(*) FILTER (c_acctbal > 0) / count(*) * 90.0 / 100), 4) AS score
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def grouped_scores_nation(spark, sf_dir):
    joined = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rules.grouped_scores(joined, ["n_name"], F.col("c_acctbal") > 0, 90.0)


@query(
    """WITH g AS (SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 4) AS s FROM customer GROUP BY 1)
    , t AS (SELECT count(*) AS g, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CAST(round(s * 10000) AS BIGINT)) AS BIGINT) AS s FROM g)
    SELECT g AS n_groups, n AS total_count, ((2 * s + 10 * g) // (20 * g)) / 1000.0 AS score, (s * n) // (1000000 * g) AS valid_count FROM t"""
)
def overall_score_segment(spark, sf_dir):
    return rules.overall(rules.grouped_scores(t(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_acctbal") > 0))


@query(
    """SELECT l_returnflag, round(sum(s * w) / sum(w), 3) AS score, count(*) AS n_measures FROM (
      SELECT l_returnflag, 100.0 * count(*) FILTER (l_quantity > 10) / count(*) AS s, 60.0 AS w FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, 100.0 * count(*) FILTER (l_discount > 0.02) / count(*), 40.0 FROM lineitem GROUP BY 1) GROUP BY 1"""
)
def rollup_lineitem(spark, sf_dir):
    one = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 10).alias("a"), F.count_if(F.col("l_discount") > 0.02).alias("b"))
    pairs = F.array(*(F.struct((100.0 * F.col(c) / F.col("n")).alias("score"), F.lit(w).alias("weight")) for c, w in (("a", 60.0), ("b", 40.0))))
    return rules.weighted_rollup(one.select("l_returnflag", F.inline(pairs)), ["l_returnflag"])


# ---------------------------------------------------------------- behaviour, history, alerts


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS slice_start, event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 3) AS mean FROM events GROUP BY 1, 2"""
)
def daily_slices_events(spark, sf_dir):
    return behaviour.slices(t(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value")


@query(oracle_sql()["daily_slices_events"])
def stream_slices_events(spark, sf_dir):
    """The slices as a stream over the same table, run until all of it is read."""
    e = t(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return behaviour.streamed(behaviour.stream_slices(stream, "ts", "1 day", ["event_type"], "value", "1 hour"), ["slice_start", "event_type"])




@query(
    f"""WITH {_HISTORY}, l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY "at") AS previous FROM h)
    SELECT series, "at", value, "at" AS run_id, previous, round(CASE WHEN value = previous THEN 0.0 WHEN previous = 0 THEN value * 100 ELSE (value - previous) / previous * 100 END, 4) AS change FROM l"""
)
def percent_change_events(spark, sf_dir):
    return history.percent_change(daily_history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT series, \"at\", value, \"at\" AS run_id FROM h QUALIFY row_number() OVER (PARTITION BY series ORDER BY \"at\" DESC) <= 7")
def last_runs_events(spark, sf_dir):
    return history.last_runs(daily_history(spark, sf_dir), 7)


@query(f"WITH {_HISTORY} SELECT series, count(*) AS n, round(avg(value) - 1.959964 * stddev_pop(value) / sqrt(count(*)), 3) AS lower, round(avg(value) + 1.959964 * stddev_pop(value) / sqrt(count(*)), 3) AS upper FROM h GROUP BY 1")
def z_interval_events(spark, sf_dir):
    return history.z_interval(daily_history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT series, \"at\" AS run_id, round(avg(value) OVER w, 3) AS moving, round(min(value) OVER w, 3) AS low, round(max(value) OVER w, 3) AS high FROM h WINDOW w AS (PARTITION BY series ORDER BY \"at\" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def range_observer_events(spark, sf_dir):
    return history.range_observer(daily_history(spark, sf_dir))


@query(
    f"""WITH {_HISTORY}, a AS (SELECT series, list(value ORDER BY "at") AS v FROM h GROUP BY 1)
    SELECT series, round(list_reduce(v, lambda acc, x: acc * 0.7 + x * 0.3), 3) AS ewma FROM a"""
)
def ewma_events(spark, sf_dir):
    return history.ewma(daily_history(spark, sf_dir))


#: 0.99 quantiles of Student's t, by degrees of freedom.
_T = ", ".join(f"({df}, {history.t_quantile(0.99, df)!r})" for df in range(1, 61))


@query(
    f"""WITH {_HISTORY}, r AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY "at") - 1 AS i, value FROM h),
    s AS (SELECT series, count(*) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean FROM r GROUP BY 1),
    w AS (SELECT r.series, r.i, any_value(r.value) AS value, avg(o.value) AS m, list(o.value) AS near FROM r JOIN r o ON o.series = r.series AND o.i BETWEEN r.i - 10 AND r.i + 10 GROUP BY 1, 2),
    c AS (SELECT w.series, CASE WHEN n > 5 AND i < CAST(floor(n * 0.8) AS BIGINT) AND abs(value - m) > 3 * 1.4826 * list_avg([abs(v - m) FOR v IN near]) THEN m ELSE value END AS value FROM w JOIN s ON s.series = w.series),
    t(df, q) AS (VALUES {_T}),
    b AS (SELECT s.series, n, low, high, s.mean, avg(c.value) AS m, stddev_samp(c.value) AS std FROM c JOIN s ON s.series = c.series GROUP BY 1, 2, 3, 4, 5),
    d AS (SELECT b.*, m - q * std / sqrt(n) - CASE WHEN std < 10 THEN std ELSE 0 END AS lo, m + q * std / sqrt(n) + CASE WHEN std < 10 THEN std ELSE 0 END AS up FROM b LEFT JOIN t ON df = n - 1),
    e AS (SELECT series, CASE WHEN low = high THEN 'constant' WHEN n <= 3 THEN 'short' ELSE 't_interval' END AS model,
          CASE WHEN low = high THEN trunc(low) WHEN n <= 3 THEN low WHEN low >= 0 THEN greatest(floor(lo), 0) ELSE floor(lo) END AS lo, CASE WHEN low = high THEN trunc(low) WHEN n <= 3 THEN mean WHEN high <= 0 THEN least(ceil(up), 0) ELSE ceil(up) END AS up FROM d)
    SELECT series, model, least(lo, up) AS lower, greatest(lo, up) AS upper FROM e"""
)
def thresholds_events(spark, sf_dir):
    return history.thresholds(daily_history(spark, sf_dir))


_ALERT = f"""WITH {_HISTORY}, b AS (SELECT series, avg(value) AS m, round(stddev_pop(value), 2) AS std FROM h GROUP BY 1),
    x AS (SELECT h.series, h."at" AS run_id, h.value, floor(m - std) AS lower, ceil(m + std) AS upper, std, ceil(h.value * 100) / 100 AS up, m FROM h JOIN b ON h.series = b.series),
    y AS (SELECT *, CASE WHEN std <= 10 THEN 3.0 WHEN std <= 150 THEN 1.5 WHEN std <= 10000 THEN CASE WHEN lower < 0 AND upper > 0 THEN 1.0 ELSE 1.5 END ELSE 1.0 END * std AS k1,
             CASE WHEN std <= 10 THEN 6.0 WHEN std <= 150 THEN 2.5 WHEN std <= 10000 THEN CASE WHEN lower < 0 AND upper > 0 THEN 1.2 ELSE 2.5 END ELSE 1.2 END * std AS k2 FROM x),
    z AS (SELECT *, CASE WHEN up >= lower AND up <= upper THEN 'Ok' WHEN up >= greatest(round(lower - k1, 2), 0) AND up <= round(upper + k1, 2) THEN 'Low' WHEN up >= greatest(round(lower - k2, 2), 0) AND up <= round(upper + k2, 2) THEN 'Medium' ELSE 'High' END AS status FROM y)
    """


@query(_ALERT + "SELECT series, run_id, value, lower, upper, status, CASE WHEN value BETWEEN lower AND upper THEN 0.0 ELSE round(abs(value - (lower + upper) / 2) / std, 2) END AS deviation FROM z")
def alerts_events(spark, sf_dir):
    return history.alerts(daily_history(spark, sf_dir)).select("series", "run_id", "value", "lower", "upper", "status", "deviation")


@query(
    f"WITH {_HISTORY} SELECT series, \"at\" AS run_id, value, CASE WHEN value > 100 OR value < 1 THEN 'High' WHEN value > 80 THEN 'Medium' WHEN value < 60 THEN 'Low' ELSE 'Ok' END AS status FROM h"
)
def manual_alerts_events(spark, sf_dir):
    v = F.col("value")
    status = history.manual_status(v, [("High", (v > 100) | (v < 1)), ("Medium", v > 80), ("Low", v < 60)])
    return daily_history(spark, sf_dir).select("series", "run_id", "value", status.alias("status"))


# ---------------------------------------------------------------- schema, nested data, records


@query(
    """SELECT * FROM (VALUES (2, 'p_name', 'string', 'p_title', 'string', 'renamed'), (3, 'p_brand', 'string', 'p_brand', 'int', 'datatype'), (6, 'p_retailprice', 'double', NULL, NULL, 'removed'))
    AS v(position, old_name, old_type, new_name, new_type, change)"""
)
def schema_diff_part(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    now = part.withColumnRenamed("p_name", "p_title").withColumn("p_brand", F.length("p_brand")).drop("p_retailprice")
    return schema.schema_diff(schema.snapshot(part), schema.snapshot(now))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_event_props(spark, sf_dir):
    return schema.flattened(t(spark, sf_dir, "events"), "props", "k", "bigint", "k").select("event_id", "k")


@query(
    """WITH p AS (SELECT DISTINCT a.n_nationkey AS x, b.n_nationkey AS y, 100.0 * (1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name))::DOUBLE) AS s FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)
    SELECT x AS left_key, y AS right_key, round(s, 3) AS similarity FROM p WHERE s >= 50"""
)
def similar_nations(spark, sf_dir):
    """Pairs of the 25 nations by edit distance (the table has a fixed size)."""
    n = t(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    s = records.ratio(F.col("a.n_name"), F.col("b.n_name"))
    return a.join(F.broadcast(b), F.col("a.n_nationkey") < F.col("b.n_nationkey")).filter(s >= 50).select(F.col("a.n_nationkey").alias("left_key"), F.col("b.n_nationkey").alias("right_key"), F.round(s, 3).alias("similarity"))


@query("SELECT c_custkey, sha256(c_name || '||' || CAST(c_nationkey AS VARCHAR)) AS record_id FROM customer")
def record_ids_customer(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", records.record_id(["c_name", "c_nationkey"]).alias("record_id"))


@query(
    """SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, length(c_mktsegment) DESC, c_mktsegment) AS rn FROM customer GROUP BY 1, 2) WHERE rn = 1"""
)
def survivors_segment(spark, sf_dir):
    return records.survivor(t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_name, p_type) AS cluster_id FROM part")
def clusters_part(spark, sf_dir):
    return records.cluster(t(spark, sf_dir, "part"), "p_partkey", F.concat_ws("|", "p_brand", "p_size"), {"p_name": "Exact", "p_type": "Exact"}, 100.0)


@query("SELECT page_id, regexp_matches(url, '^https?://') AS is_url, regexp_matches(url, '[0-9]+') AS has_number FROM pages")
def semantic_flags_pages(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.col("url").rlike("^https?://").alias("is_url"), F.col("url").rlike(patterns.pattern_regex("N", True).strip("^$")).alias("has_number"))


# ---------------------------------------------------------------- values, scores, comparisons, failed rows


def _values_sql(table: str, columns: dict[str, str]) -> str:
    out = []
    for c, k in columns.items():
        number = lambda x: f"CAST({x} AS DOUBLE)" if k == "n" else "CAST(NULL AS DOUBLE)"  # noqa: B023, E731
        text = lambda x: x if k == "s" else f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')" if k == "t" else "CAST(NULL AS VARCHAR)"  # noqa: B023, E731
        count = lambda x, kind: f"count(*) FILTER ({x})" if k == kind else "CAST(NULL AS BIGINT)"  # noqa: B023, E731
        out.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, {number(f'min({c})')} AS min_value, {number(f'max({c})')} AS max_value, {text(f'min({c})')} AS min_text, {text(f'max({c})')} AS max_text, "
            f"{count(f'{c} > 0', 'n')} AS positive_count, {count(f'{c} < 0', 'n')} AS negative_count, {count(f"""regexp_full_match({c}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)')""", 's')} AS numeric_texts FROM {table}"
        )
    return " UNION ALL ".join(out)


@query(_values_sql("lineitem", _LINEITEM | {"l_shipdate": "t"}))
def values_lineitem(spark, sf_dir):
    return health.value_measures(t(spark, sf_dir, "lineitem"))


@query(_values_sql("customer", {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}))
def values_customer(spark, sf_dir):
    return health.value_measures(t(spark, sf_dir, "customer"))


@query("SELECT 'l_extendedprice' AS column_name, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 3) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM lineitem")
def quartiles_lineitem_price(spark, sf_dir):
    q = health.quantiles(t(spark, sf_dir, "lineitem"), ["l_extendedprice"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select("column_name", *(F.round(c, 3).alias(c) for c in ("q1", "median", "q3")))


_SCORED = (("counts_valid", True, False), ("counts_invalid", False, False), ("outside_range", True, True))


@query(
    "WITH c AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS k, count(*) FILTER (o_orderstatus <> 'P') AS d FROM orders GROUP BY 1) "
    "SELECT o_orderpriority, round(100.0 * k / n, 4) AS counts_valid, round(100.0 * (n - k) / n, 4) AS counts_invalid, round(100.0 * (n - k) / n, 4) AS outside_range, round(least(100.0, 100.0 * k / d * 0.5), 4) AS of_denominator FROM c"
)
def measure_scores_orders(spark, sf_dir):
    one = t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150_000).alias("k"), F.count_if(F.col("o_orderstatus") != "P").alias("d"))
    k, n = F.col("k"), F.col("n")
    found = [F.round(health.measure_score(k, n, positive, in_range), 4).alias(name) for name, positive, in_range in _SCORED]
    return one.select("o_orderpriority", *found, F.round(health.measure_score(k, n, weight=50.0, denominator=F.col("d")), 4).alias("of_denominator"))


@query(f"""WITH {_HISTORY}, l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY "at") AS p FROM h),
    c AS (SELECT series, CASE WHEN value = p THEN 0.0 WHEN p = 0 THEN value * 100 ELSE round((value - p) / p * 100, 4) END AS change FROM l WHERE p IS NOT NULL)
    SELECT series, round(avg(change) - stddev_samp(change), 3) AS lower, round(avg(change) + stddev_samp(change), 3) AS upper FROM c GROUP BY 1""")
def percent_threshold_events(spark, sf_dir):
    return history.percent_threshold(daily_history(spark, sf_dir))


@query(f"""WITH {_HISTORY}, l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY series ORDER BY "at" DESC) <= 7)
    SELECT series, round(stddev_samp(value), 3) AS deviation, count(value) AS runs FROM l GROUP BY 1""")
def deviations_events(spark, sf_dir):
    return history.deviation_by_series(daily_history(spark, sf_dir), 7)


@query(f"""WITH {_HISTORY}, m AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w END AS mean, row_number() OVER (PARTITION BY series ORDER BY "at") AS i, count(*) OVER (PARTITION BY series) AS n
      FROM h WINDOW w AS (PARTITION BY series ORDER BY "at" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT series, "at" AS run_id, round(CASE WHEN i = 1 THEN lead(mean) OVER v WHEN i = n THEN lag(mean) OVER v ELSE mean END, 3) AS mean FROM m WINDOW v AS (PARTITION BY series ORDER BY "at")""")
def rolling_mean_events(spark, sf_dir):
    return history.rolling_mean(daily_history(spark, sf_dir)).select("series", "run_id", "mean")


@query("SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1")
def first_event_of_each_kind(spark, sf_dir):
    return history.first_rows(t(spark, sf_dir, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id")


@query("SELECT round(value, 0) AS rounded, event_id FROM events QUALIFY row_number() OVER (PARTITION BY round(value, 0) ORDER BY ts DESC, event_id DESC) = 1")
def latest_of_each_rounded_value(spark, sf_dir):
    found = history.first_rows(t(spark, sf_dir, "events").withColumn("rounded", F.round("value", 0)), ["rounded"], [F.desc("ts"), F.desc("event_id")])
    return found.select("rounded", "event_id")


@query(f"""WITH {_HISTORY} SELECT series, "at" AS run_id, CASE WHEN coalesce(lag(value) OVER (PARTITION BY series ORDER BY "at"), value) = value THEN 'Ok' ELSE 'High' END AS status FROM h""")
def steady_status_events(spark, sf_dir):
    return history.steady_status(daily_history(spark, sf_dir)).select("series", "run_id", "status")


@query(f"""WITH {_HISTORY}, a AS (SELECT series, value FROM h QUALIFY row_number() OVER (PARTITION BY series ORDER BY "at" DESC) = 1),
    b AS (SELECT series, value FROM h WHERE "at" < '2024-01-20' QUALIFY row_number() OVER (PARTITION BY series ORDER BY "at" DESC) = 1)
    SELECT a.series, a.value AS source, b.value AS target, round(abs(a.value - b.value), 4) AS difference, abs(a.value - b.value) BETWEEN 2 AND 40 AS met FROM a JOIN b ON a.series = b.series""")
def compared_events(spark, sf_dir):
    h = daily_history(spark, sf_dir)
    return history.compared(h, h.filter("at < '2024-01-20'"), "between", 2, 40)


@query(
    "WITH s AS (SELECT o_orderpriority, r.rule, r.score FROM (SELECT o_orderpriority, unnest(["
    + ", ".join(f"{{'rule': '{k}', 'score': 100.0 * count(*) FILTER ({p}) / count(*)}}" for k, p in _ORDER_SQL.items())
    + "]) AS r FROM orders GROUP BY 1)) SELECT o_orderpriority, count(DISTINCT rule) AS n_rules, count(DISTINCT CASE WHEN score >= 90 THEN rule END) AS passed, count(DISTINCT CASE WHEN score < 90 THEN rule END) AS failed FROM s GROUP BY 1"
)
def pass_statistics_orders(spark, sf_dir):
    found = _order_rules()
    counted = t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), *(F.count_if(p).alias(k) for k, p in found.items()))
    scores = counted.select("o_orderpriority", F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), health.score(F.col(k), F.col("n")).alias("score")) for k in found))))
    return rules.pass_statistics(scores, ["o_orderpriority"], 90.0)


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def cross_source_orders(spark, sf_dir):
    frames = {"orders": t(spark, sf_dir, "orders"), "people": t(spark, sf_dir, "customer")}
    return rules.cross_source(frames, "SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished FROM @orders JOIN @people ON o_custkey = c_custkey GROUP BY c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_nationkey < 20")
def upserted_customer(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    old = c.filter("c_nationkey < 20").select("c_custkey", "c_mktsegment")
    return rules.upserted(old, c.filter("c_nationkey < 5").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("c_mktsegment")), "c_custkey")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS run_id FROM events WHERE strftime(ts, '%Y-%m-%d') IN (SELECT DISTINCT strftime(ts, '%Y-%m-%d') FROM events ORDER BY 1 DESC LIMIT 5)")
def retained_events(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("run_id"))
    return rules.retained(e, e.select("run_id", F.col("run_id").alias("at")), 5)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'board' WHEN o_orderstatus = 'P' THEN 'desk' WHEN o_orderpriority LIKE '1%' THEN 'night' ELSE 'pool' END AS owner FROM orders")
def assigned_orders(spark, sf_dir):
    owners = [(F.col("o_totalprice") > 300_000, "board"), (F.col("o_orderstatus") == "P", "desk"), (F.col("o_orderpriority").like("1%"), "night")]
    return rules.assigned(t(spark, sf_dir, "orders"), owners, "pool").select("o_orderkey", "owner")


@query("SELECT * FROM (VALUES ('p_name', 'string', 2), ('p_retailprice', 'double', 6)) AS v(column_name, datatype, position)")
def deprecated_part(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    return schema.deprecated(schema.snapshot(part), schema.snapshot(part.withColumnRenamed("p_name", "p_title").drop("p_retailprice")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY")
def incremental_orders(spark, sf_dir):
    return files.incremental(t(spark, sf_dir, "orders"), "o_orderdate", 30, F.lit("1998-08-01").cast("date")).select("o_orderkey")


@query("""WITH a AS (SELECT event_type AS series, ts AS "at", event_id, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events)
    SELECT event_id, gap, gap IS NULL OR gap <= 7200 AS on_time FROM a""")
def arrivals_events(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("at"), "event_id")
    return files.arrivals(e, 3600, ties=["event_id"]).select("event_id", "gap", "on_time")


@query(f"""WITH {_HISTORY}, n AS (SELECT series FROM h GROUP BY 1 HAVING count(*) > 3) SELECT series, "at" AS run_id, value FROM h SEMI JOIN n ON h.series = n.series WHERE value > 70""")
def gated_alerts_events(spark, sf_dir):
    h = daily_history(spark, sf_dir)
    return history.gated(h.filter("value > 70"), h).select("series", "run_id", "value")


@query("SELECT o_orderkey, greatest(0.3, round(0.9 * pow(0.95, o_orderkey % 40), 6)) AS confidence FROM orders")
def confidence_orders(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.round(history.confidence(F.lit(0.9), F.col("o_orderkey") % 40), 6).alias("confidence"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS filled, " + ", ".join(f"count(*) FILTER (regexp_full_match({c}, '{p}')) AS {k}" for k, p in patterns.CONTACTS.items()) + f" FROM {table}"
        for table, c in (("pages", "url"),)
    )
)
def semantic_shares_pages(spark, sf_dir):
    return distributions.semantic_counts(t(spark, sf_dir, "pages").select("url"))


# these register their own
from plumbline.plans import adjustments, catalog, forecasts, hierarchy, linkage, reports, tracking  # noqa: E402, F401
