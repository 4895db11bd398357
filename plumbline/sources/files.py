"""Files: safe casts, dates of many formats, incremental loads, checks of files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Formats in the order in which they are tried, times before dates.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MM-dd-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
)
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "dd/MM/yyyy")


def _shape(fmt: str) -> str:
    """What every text of a format looks like: a failed parse costs far more than this look."""
    shape = re.escape(fmt.replace("'", "")).replace("yyyy", r"[+-]?\d{4,}")
    return "^" + re.sub("S+", r"\\d+", re.sub("MM|dd|HH|mm|ss", r"\\d\\d", shape)) + "$"


def any_timestamp(c: Column, formats: tuple[str, ...] = TIME_FORMATS + DATE_FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats))


def safe_cast(c: Column, kind: str) -> Column:
    """Trimmed, empty as null, and null where it doesn't fit the type."""
    trimmed = F.nullif(F.trim(c), F.lit(""))
    if kind in ("date", "timestamp"):
        # as an argument the text is computed once, not for each format
        return F.get(F.transform(F.array(trimmed), lambda x: any_timestamp(x)), 0).cast(kind)
    return trimmed.try_cast(kind)


def read_csv(spark: SparkSession, path: str, types: dict[str, str], **options: str) -> DataFrame:
    """A CSV file read as texts and cast safely."""
    texts = spark.read.options(header="true", **options).schema(", ".join(f"`{c}` string" for c in types)).csv(path)
    return texts.select(*(safe_cast(F.col(f"`{c}`"), k).alias(c) for c, k in types.items()))


def read_files(spark: SparkSession, path: str, kind: str, pattern: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """Files of a format (csv, json, parquet, orc, xml, text, avro where installed), of paths that match a pattern."""
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema else reader
    df = reader.option("recursiveFileLookup", "true").load(path) if pattern else reader.load(path)
    return df.filter(F.col("_metadata.file_path").rlike(pattern)) if pattern else df


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 25_000, **options: str) -> DataFrame:
    """A query pushed down to a database."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def incremental(df: DataFrame, column: str, days: int, today: Column | None = None) -> DataFrame:
    """Rows whose time is at most ``days`` old."""
    return df.filter(F.col(column) >= F.date_sub(today if today is not None else F.current_date(), days))


def write_metrics(df: DataFrame, path: str) -> None:
    """Append or replace by run: a run written again replaces itself, no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def aligned_union(*frames: DataFrame) -> DataFrame:
    """Rows of frames with different columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_checks(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Per file: size, md5, sha256, and its kind by its first bytes (empty: blank); files of equal content share ``copies``.

    Spark's source lists no files of zero bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    head = F.hex(F.substring("content", 1, 4))
    start = F.trim(F.substring("content", 1, 200).try_cast("string"))
    kind = F.when(start.rlike(r"^\s*$"), "empty").when(head == "50415231", "parquet").when(F.startswith(head, F.lit("1F8B")), "gzip").when(start.rlike(r"^[\[{]"), "json").when(start.rlike("^<"), "xml").otherwise("text")
    found = files.select("path", "modificationTime", F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32_decimal"), kind.alias("kind"))
    return found.withColumn("copies", F.count("*").over(Window.partitionBy("md5")))


def arrivals(files: DataFrame, seconds: int, tolerance: float = 1.0, ties: list[str] | None = None) -> DataFrame:
    """Per series of (series, at): the gap to the one before, and whether it came in time."""
    order = Window.partitionBy("series").orderBy("at", *(ties or []))
    gap = F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.lag("at").over(order).cast("timestamp"))
    return files.withColumn("gap", gap).withColumn("on_time", F.col("gap").isNull() | (F.col("gap") <= seconds * (1 + tolerance)))
