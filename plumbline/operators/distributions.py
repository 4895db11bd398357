"""Distributions of values, lengths and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.operators.health import distinct_counts

TOP = 25


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("value_count"))


def top_values(df: DataFrame, column: str, size: int = TOP) -> DataFrame:
    """The most frequent values (a report's length: ``size``), ties by value."""
    return distribution(df, F.col(column).cast("string"), "enum_value").orderBy(F.desc("value_count"), F.asc_nulls_first("enum_value")).limit(size)


def length_distribution(df: DataFrame, column: str) -> DataFrame:
    return distribution(df, F.length(column).cast("long"), "length_value")


def pattern_distribution(df: DataFrame, column: str, short: bool = True, european: bool = False) -> DataFrame:
    """Patterns with counts, number of values, space class and character class; values are counted once before any regular expression."""
    values = distribution(df, F.col(column).cast("string"), "v")
    make = patterns.short_pattern if short else patterns.long_pattern
    by_pattern = values.select(make(F.col("v"), european).alias("pattern"), "value_count", F.when(F.col("v").isNotNull(), 1).otherwise(0).alias("d"))
    counted = by_pattern.groupBy("pattern").agg(F.sum("value_count").alias("value_count"), F.sum("d").cast("long").alias("distinct_values"))
    if short:
        counted = counted.withColumns({"space_class": patterns.space_class(F.col("pattern")), "character_class": patterns.character_class(F.col("pattern"))})
    return counted


def profile_strategy(df: DataFrame, columns: list[str], most: int = 10_000, share: float = 25.0) -> DataFrame:
    """Which distribution suits each text column: enum, long_pattern, short_pattern or length."""
    one = df.agg(F.count("*").alias("n"), *(F.coalesce(F.max(F.length(c)), F.lit(0)).cast("long").alias(f"l{i}") for i, c in enumerate(columns)))
    longest = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"l{i}").alias("max_length")) for i, c in enumerate(columns)))))
    kinds = {c: F.col(f"`{c}`") for c in columns}
    lengths = distinct_counts(df, {c: F.length(v) for c, v in kinds.items()}).withColumnRenamed("distinct_count", "n_lengths")
    rows = longest.join(F.broadcast(distinct_counts(df, kinds)), "column_name").join(F.broadcast(lengths), "column_name")
    few = (F.col("distinct_count") > 0) & (F.col("distinct_count") <= most) & (100.0 * F.col("distinct_count") <= share * F.col("n"))
    return rows.select(
        "column_name", "distinct_count", "max_length", "n_lengths",
        F.when(few, "enum").when((F.col("max_length") <= 70) & (F.col("n_lengths") - 2 <= 20), "long_pattern").when(F.col("n_lengths") - 2 <= 40, "short_pattern").otherwise("length").alias("strategy"),
    )


def validity(current: DataFrame, previous: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Values of a distribution (enum_value, value_count): new since the previous one, and valid if filled and inside [low, high]."""
    before = previous.select(F.col("enum_value").alias("old")).distinct()
    joined = current.join(before, F.col("enum_value").eqNullSafe(F.col("old")), "left")
    valid = F.col("enum_value").isNotNull() & (F.trim("enum_value") != "")
    if low is not None:
        valid = valid & (F.col("enum_value") >= low)
    if high is not None:
        valid = valid & (F.col("enum_value") <= high)
    return joined.select("enum_value", "value_count", F.col("old").isNull().alias("is_new"), F.coalesce(valid, F.lit(False)).alias("is_valid"))


def semantic_counts(df: DataFrame) -> DataFrame:
    """Per text column: filled values, and how many are e-mail addresses, phone numbers, IPs, URLs, UUIDs or names; one pass."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    whole = {k: f"^(?:{p})$" for k, p in patterns.CONTACTS.items()}
    one = df.agg(*(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("filled"), *(F.count_if(F.col(f"`{c}`").rlike(p)).alias(k) for k, p in whole.items())).alias(f"m{i}") for i, c in enumerate(texts)))
    return one.select(F.inline(F.array(*(F.col(f"m{i}") for i in range(len(texts))))))


def contained_classes(df: DataFrame, column: str) -> DataFrame:
    """How many values are or contain what, as one row: null, empty, space, white_space, alphabet, digits, alphanumeric, special.

    A value of several classes counts in each: a special one (with other
    characters) also as the letters, digits and spaces that it holds, an
    alphanumeric one as letters and digits. Counted by pattern, so each pattern
    is looked at once.
    """
    p, n = F.col("pattern"), F.col("value_count")
    plain = ~p.isin("NULL", "E")
    mixed = plain & ~p.isin("S", "A", "N")
    special = mixed & (F.regexp_replace(p, "[ANS]", "") != "")
    holds = lambda x: mixed & p.contains(x)
    classes = {
        "null": p == "NULL", "empty": p == "E", "space": p == "S", "white_space": (p == "S") | holds("S"), "alphabet": (p == "A") | holds("A"), "digits": (p == "N") | holds("N"),
        "alphanumeric": mixed & p.rlike("^[AN]+$"), "special": special,
    }
    return pattern_distribution(df, column).agg(*(F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(k) for k, c in classes.items()))
