import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.operators import distributions, health, history, records, rules, schema
from plumbline.plans import registry
from plumbline.sources import files

SF = "/root/testdata/sf0.001"
#: The SQL is compared where the tables are large enough to tell.
SQL_SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"create view {n} as select * from read_parquet('{SQL_SF}/{n}.parquet')")
    return con


def _rows(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SQL_SF)
    names = sorted(got.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == names
    assert _rows(map(tuple, got.select(*names).collect())) == _rows([r[i] for i in order] for r in cursor.fetchall())


def test_stream_equals_batch(spark):
    stream = registry.queries()["stream_slices_events"](spark, SF)
    assert _rows(stream.collect()) == _rows(registry.queries()["daily_slices_events"](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_health_of_odd_columns(spark):
    df = spark.createDataFrame([(None, "", 0), (None, "  ", 1), (None, None, 0), (None, "a b", None)], "n string, s string, i int")
    got = {r.column_name: r for r in health.health_profile(df).collect()}
    assert (got["s"].null_count, got["s"].blank_count, got["s"].space_count, got["s"].non_empty) == (1, 1, 1, 1)
    assert (got["n"].null_count, got["n"].score, got["i"].zero_values) == (4, 0.0, 2)
    assert health.health_profile(df.limit(0)).count() == 3


@pytest.mark.parametrize(
    "text,long,short,space,kind",
    [
        (None, "NULL", "NULL", "no_space", "null"), ("", "E", "E", "no_space", "empty"), ("  ", "SS", "S", "no_space", "space"), ("Ab 12", "AASNN", "ASN", "inner", "with_space"),
        (" x", "SA", "SA", "leading", "with_space"), ("x ", "AS", "AS", "trailing", "with_space"), (" a1 ", "SANS", "SANS", "outer", "with_space"), (" a ", "SAS", "SAS", "no_space", "with_space"),
        ("'a\"\"", "QAQQ", "QAQ", "no_space", "special"), ("a-1", "A-N", "A-N", "no_space", "special"), ("a1", "AN", "AN", "no_space", "alphanumeric"),
    ],
)
def test_patterns(spark, text, long, short, space, kind):
    c = F.col("c")
    r = spark.createDataFrame([(text,)], "c string").select(patterns.long_pattern(c), patterns.short_pattern(c), patterns.space_class(patterns.short_pattern(c)), patterns.character_class(patterns.short_pattern(c))).first()
    assert tuple(r) == (long, short, space, kind)


def test_european_letters_and_regex(spark):
    import re

    c = F.col("c")
    assert spark.createDataFrame([("Žluť é1",)], "c string").select(patterns.long_pattern(c, True)).first()[0] == "AAAASAN"
    assert re.fullmatch(patterns.pattern_regex("AN-N", True), "abc12-3")


def test_rule_groups_and_passes(spark):
    df = spark.createDataFrame([(1, "a"), (5, None), (9, "b")], "x int, y string")
    spec = {"any": [{"not": {"column": "x", "op": "between", "value": (2, 9)}}, {"column": "y", "op": "eq", "value": "b"}]}
    assert [r.x for r in df.filter(rules.rule(spec)).collect()] == [1, 9]
    out = df.select(health.passes(F.lit(90.0)), health.passes(F.lit(90.0), "<", 95.0)).first()
    assert tuple(out) == ("fail", "pass")


def test_compare_keys_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "b")], "k int, v string")
    assert tuple(rules.compare_keys(a, b, ["k", "v"], ["k", "v"]).first()) == (2, 1, 1, 1)


def test_thresholds(spark):
    rows = [("c", str(i), i, 5.0) for i in range(4)] + [("s", str(i), i, float(v)) for i, v in enumerate((4, 8))] + [("t", str(i), i, 100.0 + i % 3) for i in range(12)] + [("n", "0", 0, None)]
    df = spark.createDataFrame(rows, "series string, run_id string, at int, value double")
    got = {r.series: (r.model, r.lower, r.upper) for r in history.thresholds(df).collect()}
    assert got["c"] == ("constant", 5.0, 5.0) and got["s"] == ("short", 4.0, 6.0) and got["n"][0] == "none"
    assert got["t"][0] == "t_interval" and got["t"][1] < 101 < got["t"][2]


def test_t_quantile():
    for p, df, want in ((0.975, 1, 12.7062), (0.99, 10, 2.7638), (0.95, 30, 1.6973)):
        assert abs(history.t_quantile(p, df) - want) < 1e-3


def test_auto_status_bands(spark):
    rows = [(10.0, 5.0, 15.0, 2.0), (20.0, 5.0, 15.0, 2.0), (26.0, 5.0, 15.0, 2.0), (40.0, 5.0, 15.0, 2.0), (11.0, 10.0, 10.0, 0.0), (15.0, 10.0, 10.0, 0.0), (None, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "v double, l double, u double, s double")
    got = [r[0] for r in df.select(history.auto_status(*map(F.col, "vlus"))).collect()]
    assert got == ["Ok", "Low", "Medium", "High", "Low", "High", None]


def test_schema_diff_and_flatten(spark):
    a, b = spark.createDataFrame([], "x int, y string"), spark.createDataFrame([], "x long, z string, w int")
    diff = {r.position: r.change for r in schema.schema_diff(schema.snapshot(a), schema.snapshot(b)).collect()}
    assert diff == {1: "datatype", 2: "renamed", 3: "added"}
    assert [r.column_name for r in schema.deprecated(schema.snapshot(a), schema.snapshot(b)).collect()] == ["y"]
    df = spark.createDataFrame([(1, '{"a":[{"b":[{"c":1},{"c":2}]},{"b":[]}]}'), (2, None), (3, "broken")], "i int, j string")
    got = sorted((r.i, r.c or 0) for r in schema.flattened(df, "j", "a.[].b.[].c", "int", "c").collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]


def test_clusters(spark):
    rows = [(1, "k", "Jon Smith"), (2, "k", "Jon Smyth"), (3, "k", "Jon Smith"), (4, "k", "Mary"), (5, "z", "Jon Smith"), (6, None, None)]
    got = {r.i: r.cluster_id for r in records.cluster(spark.createDataFrame(rows, "i int, b string, n string"), "i", F.col("b"), {"n": "ShortString"}, 85.0).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    far = spark.range(1).select(records.kilometres(F.lit(52.52), F.lit(13.405), F.lit(48.137), F.lit(11.575))).first()[0]
    assert 500 < far < 510


def test_clusters_of_a_long_chain(spark):
    # neighbours differ by one letter of 120 (99.2 %), others by more
    rows = [(i, "k", "y" * i + "x" * (120 - i)) for i in range(101)] + [(500, "k", "z" * 120), (None, "z", "alone")]
    df = spark.createDataFrame(rows, "i int, b string, n string")
    got = {r.i: r.cluster_id for r in records.cluster(df, "i", F.col("b"), {"n": "ShortString"}, 99.0).collect()}
    assert got == dict.fromkeys(range(101), 0) | {500: 500, None: None}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,d,t\n 1 ,02/13/2024, x\nbad,2024-01-02 03:04:05,\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), {"i": "int", "d": "timestamp", "t": "string"}).collect()
    assert [(r.i, r.t) for r in got] == [(1, "x"), (None, None)]
    assert got[0].d == dt.datetime(2024, 2, 13) and got[1].d == dt.datetime(2024, 1, 2, 3, 4, 5)
    (tmp_path / "b.csv").write_text((tmp_path / "a.csv").read_text())
    (tmp_path / "e.json").write_text(" \n")
    (tmp_path / "j.json").write_text('{"a": 1}')
    checks = {r.path.rsplit("/", 1)[1]: (r.kind, r.copies) for r in files.file_checks(spark, str(tmp_path)).collect()}
    assert checks == {"a.csv": ("text", 2), "b.csv": ("text", 2), "e.json": ("empty", 1), "j.json": ("json", 1)}
    gaps = spark.createDataFrame([("s", dt.datetime(2024, 1, d)) for d in (1, 2, 5)], "series string, at timestamp")
    assert [r.on_time for r in files.arrivals(gaps, 86_400, 0.5).orderBy("at").collect()] == [True, True, False]


def test_metrics_of_a_run_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run_id string, value double")
    files.write_metrics(one, path)
    files.write_metrics(spark.createDataFrame([("r2", 3.0)], "run_id string, value double"), path)
    assert sorted((r.run_id, r.value) for r in spark.read.parquet(path).collect()) == [("r1", 1.0), ("r2", 3.0)]


def test_null_keys_are_replaced(spark):
    old = spark.createDataFrame([(None, "old"), (1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(None, "new"), (2, "new"), (3, "new")], "k int, v string")
    assert sorted(map(tuple, rules.upserted(old, new, "k").collect()), key=str) == sorted([(None, "new"), (1, "old"), (2, "new"), (3, "new")], key=str)


def test_cross_source_leaves_quotes_and_the_session_alone(spark):
    a = spark.createDataFrame([(1, "@a {x}")], "i int, s string")
    before = len(spark.catalog.listTables())
    got = rules.cross_source({"a": a, "b": a}, "SELECT x.i, x.s = '@a {x}' AS same, '@b it''s @other' AS t FROM @a x JOIN @b y ON x.i = y.i")
    assert [tuple(r) for r in got.collect()] == [(1, True, "@b it's @other")] and len(spark.catalog.listTables()) == before


def test_extremes_of_dates_and_times(spark):
    df = spark.sql("SELECT DATE '2024-02-03' AS d, TIMESTAMP '2024-01-01 10:00:00.5' AS t UNION ALL SELECT DATE '2023-12-31', NULL")
    got = {r.column_name: (r.min_text, r.max_text, r.min_value) for r in health.value_measures(df).collect()}
    assert got == {"d": ("2023-12-31", "2024-02-03", None), "t": ("2024-01-01 10:00:00.500000", "2024-01-01 10:00:00.500000", None)}


def test_values_count_in_each_class_they_hold(spark):
    values = [None, "", " ", "ab", "12", "a1", "a b", "1 2", "a-1 b", "'q'", "é"]
    got = distributions.contained_classes(spark.createDataFrame([(v,) for v in values], "v string"), "v").first().asDict()
    assert got == {"null": 1, "empty": 1, "space": 1, "white_space": 4, "alphabet": 5, "digits": 4, "alphanumeric": 1, "special": 3}


def test_autoregression_bounds(spark):
    rows = [("up", i, str(i), float(2**i)) for i in range(6)] + [("two", i, str(i), 1.0 + i) for i in range(2)] + [("still", i, str(i), 5.0) for i in range(4)]
    got = {r.series: tuple(r)[1:] for r in history.autoregression_bounds(spark.createDataFrame(rows, "series string, at int, run_id string, value double")).collect()}
    assert got["up"] == (6, 64.0, 64.0, 64.0) and got["two"][1:] == (None, None, None) and got["still"][1:] == (None, None, None)
