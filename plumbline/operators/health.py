"""Health and statistics of a table's columns: one fused scan, long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.scratch import Workspace, stored

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
HEALTH = ("null_count", "blank_count", "space_count", "zero_values", "distinct_count", "min_length", "max_length")
#: Texts that are numbers.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
#: Columns measured in one aggregate; more would outgrow generated code.
COLUMNS_A_PASS = 50


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def health_measures(name: str, kind: T.DataType) -> dict[str, Column]:
    """The measures of one column; those that its type has no use for are null."""
    c, text = F.col(f"`{name}`"), isinstance(kind, T.StringType)
    none = F.lit(None).cast("long")
    return {
        "null_count": F.count_if(c.isNull()),
        "blank_count": F.count_if(c == "") if text else none,
        "space_count": F.count_if(c.rlike("^ +$")) if text else none,
        "zero_values": F.count_if(c == 0) if is_numeric(kind) else none,
        "min_length": F.min(F.length(c)).cast("long") if text else none,
        "max_length": F.max(F.length(c)).cast("long") if text else none,
    }


def long_format(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """Aggregate every measure of every column in as few scans as possible, then unpivot: one row per column."""
    names, parts = list(per_column), []
    for at in range(0, len(names), COLUMNS_A_PASS):
        group = names[at : at + COLUMNS_A_PASS]
        one = df.agg(F.count("*").alias("n"), *(F.struct(*(v.alias(k) for k, v in per_column[c].items())).alias(f"m{i}") for i, c in enumerate(group)))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"m{i}").alias("m")) for i, c in enumerate(group)))
        parts.append(one.select(F.inline(rows)).select("column_name", "row_count", "m.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """column_name, distinct_count of each value that is not null.

    Values are told apart by 128 bits of hash, and counted once per task before
    they are exchanged: narrow rows whatever the columns' widths, and no
    expansion of whole rows.
    """
    names = list(values)
    each = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(v).alias("a"), F.xxhash64(F.lit(i), v).alias("b"))) for i, v in enumerate(values.values())))
    counted = df.select(F.explode(each).alias("x")).filter("x is not null").select("x.*").distinct().groupBy("i").agg(F.count("*").alias("n"))
    all_names = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("column_name")) for i, n in enumerate(names)))
    base = df.sparkSession.range(1).select(F.inline(all_names))
    return base.join(F.broadcast(counted), "i", "left").select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("distinct_count"))


def health_profile(df: DataFrame) -> DataFrame:
    """column_name, row_count, the health measures, non_empty, duplicate_count (rows beyond the distinct
    values, nulls among them) and a 0-100 score of filled values."""
    wide = long_format(df, {f.name: health_measures(f.name, f.dataType) for f in df.schema.fields})
    order = ["column_name", "row_count", *HEALTH]
    wide = wide.join(F.broadcast(distinct_counts(df, {f.name: F.col(f"`{f.name}`") for f in df.schema.fields})), "column_name").select(*order)
    empty = F.col("null_count") + F.coalesce("blank_count", F.lit(0)) + F.coalesce("space_count", F.lit(0))
    return wide.withColumns({"non_empty": F.col("row_count") - empty, "duplicate_count": F.col("row_count") - F.col("distinct_count")}).withColumn(
        "score", F.round(score(F.col("non_empty"), F.col("row_count")), 4)
    )


def value_measures(df: DataFrame) -> DataFrame:
    """column_name, row_count, extremes (of numbers, and of texts; dates and times as texts in order), signs, and how many texts are numbers."""

    def of(f: T.StructField) -> dict[str, Column]:
        c, number, text = F.col(f"`{f.name}`"), is_numeric(f.dataType), isinstance(f.dataType, T.StringType)
        time = "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd HH:mm:ss.SSSSSS" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else None
        none = lambda kind: F.lit(None).cast(kind)
        said = lambda x: x if text else F.date_format(x, time) if time else none("string")
        return {
            "min_value": F.min(c).cast("double") if number else none("double"),
            "max_value": F.max(c).cast("double") if number else none("double"),
            "min_text": said(F.min(c)),
            "max_text": said(F.max(c)),
            "positive_count": F.count_if(c > 0) if number else none("long"),
            "negative_count": F.count_if(c < 0) if number else none("long"),
            "numeric_texts": F.count_if(c.rlike(NUMBER)) if text else none("long"),
        }

    return long_format(df, {f.name: of(f) for f in df.schema.fields})


def quantiles(df: DataFrame, columns: list[str], at: dict[str, float]) -> DataFrame:
    """column_name and the exact (interpolated) quantiles ``at`` of each numeric column.

    Values are counted, the counts sorted over all partitions, and the wanted
    positions found by running sums; only a row per partition and column is
    gathered, so no task holds a column.
    """
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)))
    with Workspace(df.sparkSession) as space:
        counted = df.select(F.inline(each)).filter("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
        ranged = space.stored(counted.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()), "ranged")
        totals = ranged.groupBy("i", "part").agg(F.sum("n").alias("t"))
        before = totals.withColumn("before", F.sum("t").over(Window.partitionBy("i").orderBy("part")) - F.col("t")).drop("t")
        size = totals.groupBy("i").agg(F.sum("t").alias("size"))
        wanted = size.select("i", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), ((F.col("size") - 1) * F.lit(p) + 1).alias("rank")) for k, p in at.items()))).alias("w")).select("i", "w.*")
        upto = F.sum("n").over(Window.partitionBy("i", "part").orderBy("v")) + F.col("before")
        placed = ranged.join(F.broadcast(before), ["i", "part"]).withColumn("upto", upto).join(F.broadcast(wanted), "i")
        inside = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        low, high = F.floor("rank"), F.ceil("rank")
        ends = placed.filter(inside(low) | inside(high)).groupBy("i", "name", "rank").agg(F.max(F.when(inside(low), F.col("v"))).alias("lo"), F.max(F.when(inside(high), F.col("v"))).alias("hi"))
        value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("rank") - F.floor("rank"))
        named = ends.withColumn("column_name", F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)).withColumn("q", value)
        return stored(named.groupBy("column_name").pivot("name", list(at)).agg(F.first("q")), "quantiles")


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range, sum, mean, median, quartiles, deviation, variance, margin of error, skewness and (population) kurtosis."""

    def of(name: str) -> dict[str, Column]:
        c = F.col(f"`{name}`").cast("double")
        found = {
            "value_range": F.max(c) - F.min(c),
            "total": F.sum(c),
            "mean": F.avg(c),
            "standard_deviation": F.stddev_samp(c),
            "variance": F.var_samp(c),
            "margin_of_error": F.lit(1.96) * F.stddev_samp(c) / F.sqrt(F.count(c)),
            "skewness": F.skewness(c),
            "kurtosis": F.kurtosis(c),
        }
        return {k: F.round(v, 3) for k, v in found.items()}

    places = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    both = long_format(df, {c: of(c) for c in columns}).join(F.broadcast(quantiles(df, columns, places)), "column_name", "left")
    return both.select("column_name", "row_count", "value_range", "total", "mean", *(F.round(q, 3).alias(q) for q in places), "standard_deviation", "variance", "margin_of_error", "skewness", "kurtosis")


def measure_score(count: Column, total: Column, positive: bool = True, in_range: bool = False, weight: float = 100.0, denominator: Column | None = None) -> Column:
    """A measure's score: its count is of valid rows where it is ``positive``, else of invalid ones; a count
    outside a range is turned into one inside it first; ``denominator`` replaces the total."""
    whole = denominator if denominator is not None else total
    count = whole - count if in_range else count
    return score(count if positive else whole - count, whole, weight)


def score(valid: Column, total: Column, weight: float = 100.0) -> Column:
    """Share of valid rows in percent, weighted and held between 0 and 100; null without rows."""
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * valid / total * weight / 100)))


def passes(value: Column, condition: str = ">=", threshold: float = 100.0) -> Column:
    """Whether a score meets its pass criterion."""
    tests = {"==": value == threshold, "!=": value != threshold, ">": value > threshold, "<": value < threshold, "<=": value <= threshold, ">=": value >= threshold}
    return F.when(tests[condition], "pass").otherwise("fail")


def table_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"), F.count_if(F.col("n") > 1).alias("duplicated_keys"))


def freshness(df: DataFrame, column: str, now: Column) -> DataFrame:
    """Seconds between the latest time of a column and ``now``."""
    return df.agg(F.max(column).cast("string").alias("latest"), (F.unix_timestamp(now) - F.unix_timestamp(F.max(column).cast("timestamp"))).alias("freshness"))
