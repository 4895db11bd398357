"""Schemas: snapshots and what changed between them; nested fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(df: DataFrame) -> DataFrame:
    """column_name, datatype and position of each column."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, datatype string, position int")


def schema_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """Changes by position: renamed (another name in a place), datatype, added, removed."""
    b = before.select("position", F.col("column_name").alias("old_name"), F.col("datatype").alias("old_type"))
    a = now.select("position", F.col("column_name").alias("new_name"), F.col("datatype").alias("new_type"))
    change = (
        F.when(F.col("old_name").isNull(), "added")
        .when(F.col("new_name").isNull(), "removed")
        .when(F.col("old_name") != F.col("new_name"), "renamed")
        .when(F.col("old_type") != F.col("new_type"), "datatype")
    )
    return b.join(a, "position", "full_outer").withColumn("change", change).filter("change is not null")


def deprecated(before: DataFrame, now: DataFrame) -> DataFrame:
    """Columns that are gone, by name."""
    return before.join(now.select("column_name"), "column_name", "left_anti")


def flattened(df: DataFrame, column: str, path: str, kind: str, name: str) -> DataFrame:
    """The values of a path like ``a.[].b`` in a JSON column, one row each (outer: rows without any stay)."""
    now = df.withColumn("_j", F.try_parse_json(column))
    steps = [p for p in path.split(".") if p]
    at = "$"
    for step in steps:
        if step == "[]":
            now = now.withColumn("_j", F.try_variant_get("_j", at, "array<variant>")).withColumn("_j", F.explode_outer("_j"))
            at = "$"
        else:
            at += f".{step}"
    return now.withColumn(name, F.try_variant_get("_j", at, kind)).drop("_j")
