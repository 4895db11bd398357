"""Behavioural slices: aggregates by category and tumbling window, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch


def slices(df: DataFrame, time: str, every: str, by: list[str], value: str) -> DataFrame:
    """slice_start, categories, n, total and mean of each window."""
    grouped = df.groupBy(F.window(F.col(time).cast("timestamp"), every).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 3).alias("mean")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("slice_start"), *by, "n", "total", "mean"
    )


def stream_slices(stream: DataFrame, time: str, every: str, by: list[str], value: str, late: str) -> DataFrame:
    """The same over a stream: windows close once the watermark, ``late`` behind, has passed them."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return slices(marked, time, every, by, value)


def streamed(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream of slices until its source is read, and return the last state of each.

    Every batch's changed slices are a folder of their own (written again if
    the batch is), below the shared folder as the stream's checkpoint is; the
    driver gets none of them.
    """
    spark, root = slices.sparkSession, scratch(slices.sparkSession)
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{root}/slices/batch={i}")
    query = slices.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema.fields)
    rest = [c for c in slices.columns if c not in keys]
    last = spark.read.schema(f"{kind}, batch long").parquet(f"{root}/slices").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*slices.columns)
