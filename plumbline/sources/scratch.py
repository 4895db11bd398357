"""Stages that cut lineage: Parquet in the shared scratch folder, and who frees it."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder named in ``spark.checkpoint.dir``.

    Where that is unset a local folder is made, and removed at exit; as other
    machines could not see it, that is an error unless the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="plumbline-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here
    and a lost executor costs no recomputation. The folder stays; it is for
    what a lazy result reads, and small."""
    return _written(df, f"{scratch(df.sparkSession)}/{name}")


class Workspace:
    """Stored stages of one operator, removed when it ends.

    What the operator's lazy result reads has to be kept outside (``stored``).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._folders: dict[str, list[str]] = {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.free(*self._folders)
        self.drop_shuffles()

    def folder(self, name: str) -> str:
        """A folder that is removed with the workspace."""
        path = scratch(self.spark)
        self._folders.setdefault(name, []).append(path)
        return path

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.folder(name)}/{name}")

    def free(self, *names: str) -> None:
        """Remove stages that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            for path in self._folders.pop(name, []):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)

    def drop_shuffles(self) -> None:
        """Spark removes shuffle files when the driver collects the plans that made them: have it do so now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
