"""Terms, footers, the shape of delimited files, digests."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import terms
from plumbline.sources import observe, structure
from tests.test_linkage import levenshtein

SF = "/root/testdata/sf0.001"


def test_terms(spark):
    names = [(1, "customer name", 0.5), (2, "Customer_Name", 0.9), (3, "custmer nam", 0.9), (4, "customer name", 0.1), (5, None, 0.5), (6, "?!", 0.5), (7, "zzz", 1.0), (8, "order date (utc)", None), (9, "order total", 0.2), (9, "order total", 0.2)]
    glossary = ["Customer Name", "Order Date", "Order Total", "Customer Name", None, "--", "date"]
    got = sorted(
        ((r.id, r.term, r.score, r.direct) for r in terms.mapped(spark.createDataFrame(names, "i int, n string, m double"), spark.createDataFrame([(g,) for g in glossary], "t string"), "i", "n", "t", "m").collect()), key=str
    )
    split = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() if w]
    docs = sorted({n for _, n, _ in names if n and split(n)})
    idf = lambda w: math.log((1 + len(docs)) / (1 + sum(w in split(d) for d in docs))) + 1 if any(w in split(d) for d in docs) else 0.0

    def vector(s):
        v = {w: split(s).count(w) * idf(w) for w in split(s)}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    want = []
    for i, n, m in names:
        best = (0, None, None)
        for g in {g for g in glossary if g and split(g)} if n and split(n) else ():
            edit = 100 * (1 - levenshtein(n.lower(), g.lower()) / max(len(n), len(g)))
            a, b = vector(n), vector(g)
            x, y = set(split(n)), set(split(g))
            s = (0.2 * sum(a[w] * b.get(w, 0) for w in a) + 0.3 * edit / 100 + 0.1 * len(x & y) / len(x | y)) / 0.6
            if edit >= 95:
                s = min(0.98 + 0.1 * (m or 0), 1.05)
            else:
                s = min(s * 0.65 if m is not None and m < 0.4 and s > 0.1 else s * (1 + 0.4 * m) if m is not None and m >= 0.85 and s >= 0.3 else s, 1.1)
            if round(s, 6) >= 0.4:
                best = min(best, (-round(s, 6), g, edit >= 95))
        want.append((i, best[1], -best[0] if best[1] else None, best[2]))
    assert [(a, b, c and round(c, 5), d) for a, b, c, d in got] == [(a, b, c and round(c, 5), d) for a, b, c, d in sorted(want, key=str)]
    assert {i: t for i, t, _, _ in got}[2] == "Customer Name" and {i: t for i, t, _, _ in got}[7] is None
    assert terms.mapped(spark.createDataFrame(names, "i int, n string, m double"), spark.createDataFrame([], "t string"), "i", "n", "t").filter("term is not null").count() == 0


def test_footers_are_enough(spark):
    before = spark.conf.get("spark.sql.sources.useV1SourceList", None)
    counts, extremes = observe.plans(spark, f"{SF}/lineitem.parquet")
    assert "PushedAggregation: [COUNT(*), COUNT(l_orderkey)" in counts and "PushedAggregation: [MIN(l_orderkey), MAX(l_orderkey)" in extremes
    got = {r.column_name: r for r in observe.observed(spark, f"{SF}/lineitem.parquet").collect()}
    scan = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.count("*"), F.min("l_quantity"), F.max("l_extendedprice")).first()
    assert (got["l_quantity"].row_count, float(got["l_quantity"].least), float(got["l_extendedprice"].most)) == (scan[0], float(scan[1]), float(scan[2]))
    assert got["l_returnflag"].least is None and got["l_returnflag"].datatype == "string"
    assert spark.conf.get("spark.sql.sources.useV1SourceList", None) == before


def test_footers_of_odd_tables(spark, tmp_path):
    spark.createDataFrame([(None, "x"), (3, "y")], "`a b` int, s string").write.parquet(f"{tmp_path}/t")
    got = {r.column_name: r for r in observe.observed(spark, f"{tmp_path}/t").collect()}
    assert (got["a b"].row_count, got["a b"].filled, got["a b"].least) == (2, 1, "3")
    spark.createDataFrame([], "a int").write.parquet(f"{tmp_path}/none")
    none = observe.observed(spark, f"{tmp_path}/none").first()
    assert (none.row_count, none.filled, none.least) == (0, 0, None)


def test_delimited_files(spark, tmp_path):
    files = {
        "good.csv": 'a,b,c\n1,2,3\n"x,y",2,3\n\n', "semi.csv": "a;b\n1;2,5\n", "tabs.csv": "\na\tb\n1\t2\n", "ragged.csv": "a,b\n1,2\n1,2,3\n1\n", "one.csv": "name\nx\ny\n", "oneragged.csv": "name\nx,y\n",
        "blank.csv": "\n  \n", "open.csv": 'a,b\n1,"open, end\n', "header.csv": "a|b|c",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    found = structure.delimited_structure(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: (r.delimiter, r.n_columns, r.n_rows, r.n_ragged, r.valid, r.error) for r in found.collect()}
    assert got == {
        "good.csv": (",", 3, 2, 0, True, None), "semi.csv": (";", 2, 1, 0, True, None), "tabs.csv": ("\t", 2, 1, 0, True, None), "ragged.csv": (",", 2, 3, 2, False, "ragged"), "one.csv": (None, 1, 2, 0, True, None),
        "oneragged.csv": (None, 1, 1, 1, False, "ragged"), "blank.csv": (None, None, 0, 0, False, "empty"), "open.csv": (",", 2, 1, 0, True, None), "header.csv": ("|", 3, 0, 0, True, None),
    }
    assert sorted(r.path.rpartition("/")[2] for r in structure.invalid_files(found).collect()) == ["blank.csv", "oneragged.csv", "ragged.csv"]


def test_delimited_files_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,text\n" + "".join(f"{i},{'x' * (i % 90)}\n" if i % 5000 else f"{i},a,b\n" for i in range(1, 60_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        found = structure.delimited_structure(spark, str(tmp_path)).first()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (found.n_columns, found.n_rows, found.n_ragged) == (2, 60_000, 12)


def test_digests(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b" {}" + b"x" * 100)
    (tmp_path / "b.parquet").write_bytes(b"PAR1 and no end")
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "large", "wb") as f:  # a hole of more than 2 GB takes no room
        f.truncate((2 << 30) + 5)
    names = ["a.json", "b.parquet", "empty", "large"]
    uri = lambda n: f"file://{tmp_path}/{n}"
    found = structure.digests(spark.createDataFrame([(uri(n),) for n in [*names, "a.json"]] + [(None,)], "path string"))
    got = {r.path.rpartition("/")[2]: r for r in found.collect()}
    assert sorted(got) == sorted(names)
    raw = (tmp_path / "a.json").read_bytes()
    assert (got["a.json"].md5, got["a.json"].sha256, got["a.json"].crc32) == (hashlib.md5(raw).hexdigest(), hashlib.sha256(raw).hexdigest(), f"{zlib.crc32(raw):08x}")
    assert {n: got[n].kind for n in names[:3]} == {"a.json": "json", "b.parquet": "broken parquet", "empty": "empty"}
    assert got["large"].size == (2 << 30) + 5
    small = spark.createDataFrame([tuple(got[n]) for n in names[:3]], found.schema)
    declared = spark.createDataFrame([(uri("a.json"), "MD5", got["a.json"].md5.upper()), (uri("b.parquet"), "sha256", "00"), (uri("gone"), "md5", "00"), (uri("a.json"), "crc64", "1")], "path string, algorithm string, digest string")
    states = sorted((r.path.rpartition("/")[2], r.state) for r in structure.checked_digests(small, declared).collect())
    assert states == [("a.json", "ok"), ("a.json", "unknown"), ("b.parquet", "changed"), ("empty", "undeclared"), ("gone", "missing")]
    with pytest.raises(Exception, match="gone"):
        structure.digests(spark.createDataFrame([(uri("gone"),)], "path string")).collect()


def test_shapes_let_every_date_through(spark):
    from pyspark.sql import functions as F

    from plumbline.sources import files

    formats = files.TIME_FORMATS + files.DATE_FORMATS
    at = F.lit("2021-03-04 05:06:07.120000").cast("timestamp")
    written = spark.range(1).select(*(F.date_format(at, f).alias(f"x{i}") for i, f in enumerate(formats))).first()
    import re

    assert all(re.search(files._shape(f), x) for f, x in zip(formats, written, strict=True))
    rows = spark.createDataFrame([(x,) for x in [*written, "", " 2021/03/04 ", "soon", "2021-3-4", None]], "x string")
    got = [r.d for r in rows.select(files.safe_cast(F.col("x"), "date").alias("d")).collect()]
    assert got[0].isoformat() == "2021-03-04" and got[-5] is None and got[-4].isoformat() == "2021-03-04" and got[-3:] == [None] * 3
    assert all(d is not None for d in got[: len(formats)])
