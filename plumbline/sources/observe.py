"""Tables observed without reading their rows: what the footers of Parquet files hold.

Counts and extremes of numbers, dates and flags are answered from footers by
Spark's aggregate push-down; no data page is read. A column with nulls may have
row groups without extremes, so its extremes are read from that column alone.
Of columns of other types only the type is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "column_name string, datatype string, position int, row_count long, filled long, least string, most string"
_KINDS = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date"}


@contextmanager
def _pushed_down(spark: SparkSession) -> Iterator[None]:
    """Parquet by the source that pushes aggregates down; the session's settings come back."""
    wanted = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"filled_{c}") for c in columns))


def _extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(f(F.col(f"`{c}`")).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))))


def _known(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in _KINDS]


def plans(spark: SparkSession, path: str) -> tuple[str, str]:
    """How footers are read for counts and for extremes: the scans name what is pushed down to them."""
    with _pushed_down(spark):
        df = spark.read.parquet(path)
        return tuple(x._jdf.queryExecution().toString() for x in (_counts(df, _known(df)), _extremes(df, _known(df))))


def observed(spark: SparkSession, path: str) -> DataFrame:
    """Columns of a table of Parquet files: name, type, position, row_count, and where the type allows it how many are filled, the least and the most.

    One row a column, whatever the table holds. Files whose writer left no
    statistics of a column without nulls are an error of Spark's, which names the
    file. A table without rows has counts of 0 and no extremes.
    """
    with _pushed_down(spark):
        df = spark.read.parquet(path)
        row = {k: v or 0 for k, v in _counts(df, _known(df)).first().asDict().items()}  # no files: null
        full = [c for c in _known(df) if row[f"filled_{c}"] == row["n"] > 0]
        row |= _extremes(df, full).first().asDict() if full else {}
    gaps = [c for c in _known(df) if 0 < row[f"filled_{c}"] < row["n"]]
    row |= _extremes(spark.read.parquet(path), gaps).first().asDict() if gaps else {}
    said = lambda x: None if x is None else str(x)
    rows = [(c, kind, k, row["n"], row.get(f"filled_{c}"), said(row.get(f"least_{c}")), said(row.get(f"most_{c}"))) for k, (c, kind) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, _SCHEMA)


def observed_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``observed`` of several tables, with a table column."""
    out = None
    for name, path in paths.items():
        part = observed(spark, path).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out
