"""Where queries register, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can express it."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily row counts per event type, as a metric history."""
    e = t(spark, sf_dir, "events").select("event_type", F.date_format(F.col("ts"), "yyyy-MM-dd").alias("at"))
    return e.groupBy(F.col("event_type").alias("series"), "at").agg(F.count("*").cast("double").alias("value")).withColumn("run_id", F.col("at"))


_HISTORY = "h AS (SELECT event_type AS series, strftime(ts, '%Y-%m-%d') AS \"at\", CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"


def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's highest value and number of events of each type a day: many series of many lengths."""
    e = t(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("of"), F.date_format(F.col("ts"), "yyyy-MM-dd").alias("at"), "value")
    daily = e.groupBy("of", "at").agg(F.max("value").alias("v"), F.count("*").cast("double").alias("n"))
    both = F.array(*(F.struct(F.concat(F.lit(f"{c}|"), "of").alias("series"), F.col(c).alias("value")) for c in ("v", "n")))
    return daily.select("at", F.explode(both).alias("x")).select("x.series", "at", "x.value", F.col("at").alias("run_id"))


#: ``u`` are its rows, ``r`` the same with runs from 0.
_USERS = """d AS (SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS k, strftime(ts, '%Y-%m-%d') AS "at", max(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
    u AS (SELECT 'v|' || k AS series, "at", v AS value FROM d UNION ALL SELECT 'n|' || k, "at", n FROM d),
    r AS (SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY "at") - 1 AS INTEGER) AS i, value FROM u)"""
