"""Behavioural slices that grow by increments: stored partial aggregates and a high-water mark.

A store is a folder with, for each increment (named by a number), its mark
(the times it covers: after ``low``, up to ``high``) and its partial aggregates by slice and
categories. An increment takes the rows after the last increment's high-water
mark, so each row counts once; one that runs again (after a failure, say) finds
its own mark and replaces its own partials, so replays change nothing. The mark
is written before the partials: an increment that failed between the two leaves
a hole that its replay fills.

Rows come pre-aggregated from each task; only a mark's two numbers come to the
driver. Edge cases: rows without a time are left out, as are rows that come
later than a mark that covers them; null values don't count in sums and
extremes; a null category is a category; an increment without new rows keeps
the mark; a store without increments has no slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days of a month and a year, where an interval is given in them (fixed values).
DAYS = {"days": 1, "months": 30, "years": 365}
_MARK = "batch int, low long, high long"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


class SliceStore:
    """Slices of one table below ``path`` (a folder that all machines share).

    time: the column of times; every: a slice, such as ``1 day``; by: categories;
    values: numeric columns. first: how far back the first increment reads, as
    (number, days, months or years); everything where it is None.
    """

    def __init__(self, spark: SparkSession, path: str, time: str, every: str, by: list[str], values: list[str], first: tuple[int, str] | None = None):
        self.spark, self.path, self.time, self.every, self.by, self.values, self.first = spark, path.rstrip("/"), time, every, list(by), list(values), first

    def marks(self) -> DataFrame:
        """batch, low and high (microseconds; low is null in a first increment that reads everything)."""
        if not _exists(self.spark, f"{self.path}/marks"):
            return self.spark.createDataFrame([], _MARK)
        return self.spark.read.schema(_MARK).parquet(f"{self.path}/marks")

    def _mark(self, batch: int, micros, rows: DataFrame) -> tuple[int | None, int | None]:
        """The times that an increment covers: as stored, if it ran before."""
        own = self.marks().filter(F.col("batch") == batch).first()
        if own:
            return own.low, own.high
        low = self.marks().filter(F.col("batch") < batch).agg(F.max("high")).first()[0]
        later = self.marks().filter(F.col("batch") > batch).limit(1).count()
        if later:
            raise ValueError(f"increment {batch} comes before one that is stored")
        latest = rows.agg(F.max(micros)).first()[0]
        if low is None and self.first and latest is not None:
            low = latest - self.first[0] * DAYS[self.first[1]] * 86_400_000_000
        high = low if latest is None else latest if low is None else max(low, latest)
        self.spark.createDataFrame([(low, high)], "low long, high long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")
        return low, high

    def add(self, df: DataFrame, batch: int) -> None:
        """Process an increment: the rows of ``df`` after the last mark."""
        base = self._base()
        if base is not None and batch <= base:
            raise ValueError(f"increment {batch} is part of the base that ends with {base}")
        at = F.col(self.time).cast("timestamp")
        micros = F.unix_micros(at)
        low, high = self._mark(batch, micros, df)
        rows = df.filter(F.lit(False)) if high is None else df.filter(micros <= high)
        rows = rows if low is None else rows.filter(micros > low)
        parts = [F.count("*").alias("n")]
        for v in self.values:
            c = F.col(v).cast("double")
            parts += [F.count(c).alias(f"n_{v}"), F.sum(c).alias(f"sum_{v}"), F.sum(c * c).alias(f"square_{v}"), F.min(c).alias(f"min_{v}"), F.max(c).alias(f"max_{v}")]
        partial = rows.groupBy(F.window(at, self.every).getField("start").alias("slice_start"), *self.by).agg(*parts)
        partial.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/partials/batch={batch}")

    def _partials(self) -> DataFrame:
        """The latest base and the increments after it."""
        base = self._base()
        if base is None and not _exists(self.spark, f"{self.path}/partials"):
            raise FileNotFoundError(f"{self.path} holds no increments")
        parts = self.spark.read.parquet(f"{self.path}/partials") if _exists(self.spark, f"{self.path}/partials") else None
        if base is None:
            return parts.drop("batch")
        whole = self.spark.read.parquet(f"{self.path}/bases/batch={base}")
        return whole if parts is None else whole.unionByName(parts.filter(F.col("batch") > base).drop("batch"))

    def _base(self) -> int | None:
        """The last increment that a finished compaction covers."""
        if not _exists(self.spark, f"{self.path}/bases"):
            return None
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bases")
        found = [x.getPath() for x in top.getFileSystem(conf).listStatus(top)]
        return max((int(p.getName().partition("=")[2]) for p in found if _exists(self.spark, f"{p}/_SUCCESS")), default=None)

    def _summed(self) -> DataFrame:
        sums = {"n": F.sum("n")}
        for v in self.values:
            sums |= {f"n_{v}": F.sum(f"n_{v}"), f"sum_{v}": F.sum(f"sum_{v}"), f"square_{v}": F.sum(f"square_{v}"), f"min_{v}": F.min(f"min_{v}"), f"max_{v}": F.max(f"max_{v}")}
        return self._partials().groupBy("slice_start", *self.by).agg(*(c.alias(k) for k, c in sums.items()))

    def slices(self) -> DataFrame:
        """slice_start, categories, n, and of each value n, total, mean, deviation (population), least and most."""
        out = [F.date_format("slice_start", "yyyy-MM-dd HH:mm:ss").alias("slice_start"), *self.by, "n"]
        for v in self.values:
            mean = F.try_divide(f"sum_{v}", f"n_{v}")
            spread = F.sqrt(F.greatest(F.try_divide(f"square_{v}", f"n_{v}") - mean * mean, F.lit(0.0)))
            out += [f"n_{v}", F.round(f"sum_{v}", 2).alias(f"total_{v}"), F.round(mean, 6).alias(f"mean_{v}"), F.round(spread, 6).alias(f"deviation_{v}"), f"min_{v}", f"max_{v}"]
        return self._summed().select(*out)

    def compact(self) -> None:
        """All increments so far as one base; they can't run again after that. A compaction that fails leaves the store as it was."""
        last = self.marks().agg(F.max("batch")).first()[0]
        if last is None or last == self._base():
            return
        self._summed().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/bases/batch={last}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/partials")
        path.getFileSystem(conf).delete(path, True)
