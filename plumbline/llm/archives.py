"""WARC files from legacy ARC archives.

ARC has two versions, told apart by the archive's first record: version 1
record lines have five fields (URL, IP, date, type, length), version 2 lines
ten (with result code, checksum, location, offset and file name). The converter
walks an archive by declared lengths, never by searching payloads, and
synthesises what WARC asks for: record ids (a name-based UUID of the ARC
record), ISO timestamps from 14 digits, types, block and payload digests.
Records whose payload another record has already become revisits.

Archives are indexed and read back with Spark's binaryFile source and written
with its text writer (a row is an archive, one file and gzip member each); the
conversion opens each by its URI (file, hdfs, s3, gs) in the task that gets its name.
Archives are cut at ARCHIVE_BYTES of payload (a larger record is one of its
own); a task holds one archive at a time. Which record is the response of a
payload is decided on an index of small rows (file, offset, id, digest), not by
moving payloads.

Edge cases: null html counts as an empty payload; null or odd URLs are written
as percent-encoded names; rows that repeat the response's id are responses too;
rows without an id revisit the response of their payload, and are responses
themselves where no row of the payload has an id;
empty tables give no archives; payloads may hold anything, blank lines and
lines like record headers included; columns other than id, url and html are
not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import arrow_schema, bounded_batches, required, stored
from plumbline.sources.scratch import Workspace

ARCHIVE_BYTES = 4 << 20
#: Payloads of fewer bytes are never deduplicated.
LEAST_DEDUPED = 0
NO_DATE = "19700101000000"
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_INDEX = "path string, at long, page_id long, payload_bytes long, digest string, uri string, date string"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(raw: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


# ---------------------------------------------------------------- ARC


def _named(page_id: int | None) -> str:
    return "-" if page_id is None else str(page_id)


def _id(name: str) -> int | None:
    return None if name == "-" else int(name)


def _http(page_id: int | None, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: %s\r\nContent-Length: %d\r\n\r\n" % (_named(page_id).encode(), len(payload)) + payload


def arc_head(version: int, name: str) -> bytes:
    """The version block that begins an archive."""
    body = f"{version} 0 plumbline\n{_FIELDS[version]}\n".encode()
    rest = b"%d" % len(body) if version == 1 else b"200 - - 0 %s %d" % (name.encode(), len(body))
    return b"filedesc://%s 0.0.0.0 %s text/plain %s\n%s\n" % (name.encode(), NO_DATE.encode(), rest, body)


def arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    line = f"{url} 0.0.0.0 {date} text/html "
    line += f"{len(block)}" if version == 1 else f"200 {digest(block)} - {offset} {name} {len(block)}"
    return line.encode() + b"\n" + block + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of an archive of either version."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"record line without an end at {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"no declared length at {at}")
        begin = end + 1
        stop = begin + int(values[-1])
        if stop > len(data):
            raise ValueError(f"record at {at} is cut off")
        block = data[begin:stop]
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("no version block")
            lines = block.decode().splitlines()
            version = int(lines[0].split(" ")[0])
            fields = lines[1].split(" ")
            if fields != _FIELDS.get(version, "").split(" "):
                raise ValueError(f"unknown version {version}")
        else:
            if len(values) != len(fields):
                raise ValueError(f"{len(values)} fields at {at}")
            yield at, dict(zip(fields, values, strict=True)), block
        at = stop


def _payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    named = (x.decode("latin-1").partition(": ") for x in head.split(b"\r\n")[1:])
    return {k.lower(): v for k, _, v in named}, payload


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2), id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = NO_DATE) -> None:
    """Pages as gzipped ARC archives below ``path``; the versions take turns."""
    out = arrow_schema("value string")
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, made, version, name = [], 0, 0, 1, ""

        def archive() -> pa.RecordBatch:
            # the text writer ends the row with the line feed that ends the last record
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary()).cast(pa.string())], schema=out)

        for batch in batches:
            for i, url, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if parts and size + len(raw or b"") > ARCHIVE_BYTES:
                    yield archive()
                    parts, size = [], 0
                if not parts:
                    made += 1
                    version, name = versions[made % len(versions)], f"plumbline-{made}.arc"
                    parts = [arc_head(version, name)]
                    size = len(parts[0])
                parts.append(arc_record(version, name, size, quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{i}", date, _http(i, raw or b"")))
                size += len(parts[-1])
        if parts:
            yield archive()

    rows = required(pages, **{id_col: "long", url_col: "string", text_col: "string"}).mapInArrow(run, "value string")
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


# ---------------------------------------------------------------- WARC


def warc_record(kind: str, uri: str, date: str, ident: str, payload: bytes, block: bytes, page_id: int | None, refers: tuple[int, str, str] | None) -> bytes:
    """One record; a revisit keeps the HTTP header only and names the response."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{ident}>",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {_named(page_id)}",
    ]
    if refers:
        block = block[: len(block) - len(payload)]
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{refers[2]}>",
            f"WARC-Refers-To-Target-URI: {refers[1]}",
            f"X-Refers-To-Page: {refers[0]}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(uri: str, date: str, payload_digest: str, page_id: int | None) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {date} {payload_digest} {page_id}"))


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at {at}")
        named = (x.decode("utf-8", "replace").partition(": ") for x in data[at:end].split(b"\r\n")[1:])
        head = {k.lower(): v for k, _, v in named}
        begin = end + 4
        stop = begin + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"wrong length at {at}")
        yield head, data[begin:stop]
        at = stop + 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    # each task takes few archives, as each is held whole
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def _indexed():
    out = arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, head, block in arc_records(gzip.decompress(content.as_py())):
                    http, payload = _payload(block)
                    rows.append((path, at, _id(http["x-page-id"]), len(payload), digest(payload), head["URL"], head["Archive-date"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return run


def _opened(path: str) -> bytes:
    """An archive by its URI, as Spark names it."""
    files, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with files.open_input_stream(name, compression=None) as stream:
        return gzip.decompress(stream.read())


def _converted():
    """Archives of (path, revisits) rows, opened by the task that converts them."""
    out = arrow_schema("value string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                refers = {x["at"]: (x["page"], x["uri"], record_id(x["uri"], x["date"], x["digest"], x["page"])) for x in revisits.as_py() or ()}
                parts = []
                for at, head, block in arc_records(_opened(path)):
                    http, payload = _payload(block)
                    page = _id(http["x-page-id"])
                    ident = record_id(head["URL"], head["Archive-date"], digest(payload), page)
                    parts.append(warc_record("revisit" if at in refers else "response", head["URL"], head["Archive-date"], ident, payload, block, page, refers.get(at)))
                if parts:  # a task without pages leaves an archive without records
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-4]], pa.binary()).cast(pa.string())], schema=out)

    return run


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert all archives below ``arc_path``; one WARC file for each."""
    with Workspace(spark) as space:
        _convert(spark, arc_path, warc_path, space.stored(_files(spark, arc_path).mapInArrow(_indexed(), _INDEX), "index"))


def _convert(spark: SparkSession, arc_path: str, warc_path: str, index: DataFrame) -> None:
    first = index.filter((F.col("payload_bytes") >= LEAST_DEDUPED) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "uri", "date")).alias("r")).select("digest", "r")
    again = index.join(first, "digest").filter("page_id is null or page_id > r.page_id")
    # one row per archive: as many as an archive has records, at most
    revisits = again.groupBy("path").agg(F.collect_list(F.struct("at", F.col("r.page_id").alias("page"), F.col("r.uri").alias("uri"), F.col("r.date").alias("date"), "digest")).alias("revisits"))
    # the join is of names; what the archives hold is never exchanged
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(arc_path).select("path")
    # an archive or two for each task, as adaptive execution would put such small rows together
    rows = names.join(revisits, "path", "left").select("path", "revisits").repartition(max(1, names.count() // 2), "path").mapInArrow(_converted(), "value string")
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", 1).option("lineSep", "\r\n\r\n").text(warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records: page_id, payload_bytes, payload_digest, record_type, refers_to. Digests of what is there are checked."""
    out = arrow_schema(_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in warc_records(gzip.decompress(content.as_py())):
                    _, payload = _payload(block)
                    kind, named = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != named or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                    refers = head.get("x-refers-to-page")
                    rows.append((_id(head["x-page-id"]), int(head["x-payload-length"]), named, kind, int(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return _files(spark, path).select("content").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    bounded_batches(spark)
    with Workspace(spark) as space:
        arc, warc = space.folder("arc"), space.folder("warc")
        write_arc(pages, arc, id_col=id_col)
        arc_to_warc(spark, arc, warc)
        return stored(read_warc(spark, warc), "records").withColumnRenamed("page_id", id_col)
