"""Files checked before they are loaded: the shape of delimited files, and digests, of files of any size.

Delimited files are read as lines by byte ranges, so a large file is many
tasks; digests are taken in pieces of CHUNK bytes by one task a file, which
opens it by its URI (file, hdfs, s3, gs), as a digest goes through a file in
order. Nothing of a file comes to the driver.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 5 << 20
DELIMITERS = [",", ";", "\t", "|"]


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, r'"[^"]*"?', "")


def delimited_structure(spark: SparkSession, path: str) -> DataFrame:
    """Of each delimited text file: path, delimiter, n_columns, n_rows (without the header), n_ragged, valid and error.

    The delimiter is the one that the header has most often outside of quotes
    (commas first, then as listed; a header without any is one column). Ragged rows have another
    number of them. Valid: a header with a name, no ragged rows. Blank lines don't count; a file of blanks is
    empty; files of zero bytes are not listed by Spark's source. A quoted line end counts as one.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("order"))
    plain = lines.withColumn("blank", F.trim("value") == "").withColumn("bare", _outside_quotes(F.col("value")))
    counts = F.array(*(F.length("bare") - F.length(F.replace("bare", F.lit(d), F.lit(""))) for d in DELIMITERS))
    plain = plain.select("path", "order", "blank", counts.alias("counts"))
    header = plain.groupBy("path").agg(F.min_by("counts", F.when(~F.col("blank"), F.col("order"))).alias("header"), F.min(F.when(~F.col("blank"), F.col("order"))).alias("first"))
    most = F.array_max("header")
    which = F.array_position("header", most) - 1
    header = header.withColumn("which", F.when(most > 0, which.cast("int"))).withColumn("most", most)
    # the headers are one row a file; lines are counted by file and number of delimiters before they meet them
    shapes = plain.filter("not blank").groupBy("path", "counts").agg(F.count("*").alias("n"))
    joined = header.join(shapes, "path", "left")
    ragged = F.when(F.col("which").isNotNull(), F.get("counts", F.col("which")) != F.col("most")).otherwise(F.array_max("counts") > 0)
    found = joined.groupBy("path", "which", "most").agg((F.coalesce(F.sum("n"), F.lit(0)) - F.when(F.first("first").isNotNull(), 1).otherwise(0)).alias("n_rows"), F.coalesce(F.sum(F.when(ragged, F.col("n"))), F.lit(0)).alias("n_ragged"))
    error = F.when(F.col("most").isNull(), "empty").when(F.col("n_ragged") > 0, "ragged")
    delimiter = F.get(F.array(*map(F.lit, DELIMITERS)), F.col("which"))
    return found.select("path", delimiter.alias("delimiter"), (F.col("most") + 1).cast("int").alias("n_columns"), "n_rows", "n_ragged", error.isNull().alias("valid"), error.alias("error"))


def invalid_files(structure: DataFrame) -> DataFrame:
    return structure.filter("not valid").select("path", "error")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = ["path", "size", "md5", "sha256", "crc32", "kind"]
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            files, name = fs.FileSystem.from_uri(uri)
            md5, sha, crc, size, head, tail = hashlib.md5(), hashlib.sha256(), 0, 0, b"", b""
            with files.open_input_stream(name) as stream:
                while piece := stream.read(CHUNK):
                    md5.update(piece), sha.update(piece)
                    crc, size = zlib.crc32(piece, crc), size + len(piece)
                    head = head or piece[:200]
                    tail = (tail + piece[-4:])[-4:]
            rows.append((uri, size, md5.hexdigest(), sha.hexdigest(), f"{crc:08x}", _kind(head, tail, size)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names) if rows else pa.RecordBatch.from_pylist([], pa.schema([(n, pa.int64() if n == "size" else pa.string()) for n in names]))


def _kind(head: bytes, tail: bytes, size: int) -> str:
    """By the first bytes; a Parquet file that doesn't end as one is broken."""
    start = head.lstrip()
    if not start:
        return "empty"
    if head[:4] == b"PAR1":
        return "parquet" if tail == b"PAR1" and size >= 12 else "broken parquet"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    return "json" if start[:1] in b"[{" else "xml" if start[:1] == b"<" else "text"


def digests(files: DataFrame, path_col: str = "path") -> DataFrame:
    """path, size, md5, sha256, crc32 and kind of each file named by a URI; a file that can't be opened is an error."""
    spread = files.select(F.col(path_col).cast("string").alias("path")).filter("path is not null").distinct().repartition("path")
    return spread.mapInArrow(_digested, "path string, size long, md5 string, sha256 string, crc32 string, kind string")


def checked_digests(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Against a declared list (path, algorithm, digest): path, algorithm, declared, digest, state.

    Digests are compared without regard to case; state is ok, changed, missing
    (declared, not found), undeclared, or unknown (an algorithm that isn't taken).
    """
    taken = found.select("path", F.explode(F.create_map(*(y for a in ("md5", "sha256", "crc32") for y in (F.lit(a), F.col(a))))).alias("algorithm", "digest"))
    d = declared.select("path", F.lower("algorithm").alias("algorithm"), F.lower("digest").alias("declared"))
    both = d.join(taken, ["path", "algorithm"], "left").join(found.select("path", F.lit(True).alias("there")), "path", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("digest").isNull(), "unknown").when(F.col("digest") == F.col("declared"), "ok").otherwise("changed")
    extra = found.join(declared.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("algorithm"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("digest"), F.lit("undeclared").alias("state"))
    return both.select("path", "algorithm", "declared", "digest", state.alias("state")).unionByName(extra)
