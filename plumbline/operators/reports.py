"""Reports: pivots, nested groups, runs of pipelines, date windows, parents and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pivoted(df: DataFrame, by: list[str], cases: dict[str, Column]) -> DataFrame:
    """Per group all rows, and those of each case in a column of its own."""
    return df.groupBy(*by).agg(F.count("*").alias("total_count"), *(F.count_if(c).alias(n) for n, c in cases.items()))


def nested_groups(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Rows and total of every prefix of ``by``: level 0 is the whole, and columns beyond a row's level are null."""
    level = sum((1 - F.grouping(c).cast("int") for c in by), F.lit(0))
    return df.rollup(*by).agg(level.alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))


def run_measures(runs: DataFrame) -> DataFrame:
    """Of each series' latest run (run_id, at, ended, volume): its seconds, the seconds since the run before, its volume.

    A series of one run has no delay. Only the last two runs of a series leave
    a task, however many there are.
    """
    order = Window.partitionBy("series").orderBy(F.desc("at"), F.desc("run_id"))
    last = runs.withColumn("rn", F.row_number().over(order)).filter("rn <= 2").groupBy("series")
    of = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    seconds = lambda a, b: F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))
    return last.agg(of("run_id", 1).alias("run_id"), seconds(of("ended", 1), of("at", 1)).alias("duration"), seconds(of("at", 1), of("at", 2)).alias("delay"), of("volume", 1).alias("volume"))


def in_window(day: Column, kind: str, today: Column, n: int = 1) -> Column:
    """Whether a day is today, yesterday, or among the last ``n`` days or months up to today."""
    first = {"today": today, "yesterday": F.date_sub(today, 1), "days": F.date_sub(today, n - 1), "months": F.date_add(F.add_months(today, -n), 1)}[kind]
    last = F.date_sub(today, 1) if kind == "yesterday" else today
    return day.cast("date").between(first, last)


def parent_scores(scores: DataFrame, parent: str) -> DataFrame:
    """Children's scores as their parents': the mean of those there are, to three places (summed in whole numbers,
    so that no tie depends on the order of rows)."""
    grouped = scores.filter("score is not null").groupBy(parent).agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 10_000).cast("long")).alias("s"))
    return grouped.select(parent, F.col("n").alias("n_children"), (F.expr("(2 * s + 10 * n) div (20 * n)") / 1000).alias("score"))


def with_latest(parents: DataFrame, key: str, rows: DataFrame, row_key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Each parent with its latest row, nulls where it has none. The latest row is an aggregate, so that a parent of
    very many rows is one row of the join."""
    latest = rows.groupBy(F.col(row_key).alias("_key")).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_row"))
    return parents.join(latest, F.col(key) == F.col("_key"), "left").select(*parents.columns, *(F.col("_row")[c].alias(c) for c in keep))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows of a group numbered from one, as issues of an organisation are."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """The rank of a row in its group; equal rows have one rank."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order)))


def sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The rows whose hashed keys come first: the same ones for a seed, however the table is partitioned."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(rows)


def distinct_union(*frames: DataFrame) -> DataFrame:
    """Rows that any of the frames has, once."""
    return reduce(DataFrame.unionByName, frames).distinct()


def shapes(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count and column_count of each frame."""
    one = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count")) for n, df in frames.items()]
    return reduce(DataFrame.unionByName, one)
