"""Similar records, clusters by increments and links, against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import linkage
from plumbline.operators.linkage import Field
from plumbline.plans import linkage as queries

SF = "/root/testdata/sf0.01"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(kind, a, b):
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if kind == "ShortString":
        return 100 * (1 - levenshtein(a, b) / max(len(a), len(b)))
    if kind == "String":
        s, big = sorted((a, b), key=len)
        return 100 * (1 - min(levenshtein(s, big[i : i + len(s)]) for i in range(len(big) - len(s) + 1)) / len(s))
    if kind == "Set":
        x, y = set(re.split(" +", a.lower())), set(re.split(" +", b.lower()))
        return 100 * len(x & y) / len(x | y)
    if kind == "Price":
        try:
            return 100.0 * (abs(float(a) - float(b)) < 0.01)
        except ValueError:
            return 0.0
    return 100.0 * (a == b)


def people(n=160, seed=3):
    r = random.Random(seed)
    names = [f"{a} {b}" for a in ("anna", "bert", "clara", "dieter", "eva maria") for b in ("schmidt", "schmitt", "o'neil", "lovelace", "van der berg")]
    rows = [(None, "", None, None), (1, None, "", "x"), (2, "a", "b", "1"), (3, "ab", "b", "1.001")]
    for i in range(4, n):
        name = r.choice(names)
        if r.random() < 0.5:
            k = r.randrange(len(name))
            name = name[:k] + r.choice(["", "x", name[k] * 2]) + name[k + 1 :]
        rows.append((i, name, r.choice(["red car", "red Car", "car red big", "blue"]), r.choice(["10", "10.00", "10.004", "12.5", "n/a", None])))
    return rows


SCHEMA = "id long, name string, words string, price string"


@pytest.mark.parametrize(
    "fields, key, least",
    [
        ([Field("name")], ("name",), 80.0),
        ([Field("name", ("String",))], ("name",), 85.0),
        ([Field("name", weight=2.0), Field("words", ("Set",)), Field("price", ("Price",))], ("name",), 75.0),
        ([Field("name", ("ShortString", "String"), 3.0), Field("words", ("Set",), 2.0), Field("price", ("Price", "Exact"))], ("name", "words"), 90.0),
        ([Field("words", ("Set",)), Field("price", ("Price",))], ("price", "words"), 66.0),
    ],
)
def test_pairs_equal_all_pairs(spark, fields, key, least):
    rows = people()
    df = spark.createDataFrame(rows, SCHEMA)
    ids = {r.node: r.content for r in linkage.with_node(df, fields).select("node", F.array(*(f.name for f in fields)).alias("content")).collect()}
    got = {frozenset(map(tuple, (ids[r.u], ids[r.v]))): r.score for r in linkage.similar_records(df, fields, [key], least).collect()}
    at = {"name": 1, "words": 2, "price": 3}
    content = sorted({tuple(r[at[f.name]] for f in fields) for r in rows}, key=str)
    want = {}
    for a, b in itertools.combinations(content, 2):
        s = sum(f.weight * max(plain(k, (x or "").strip(), (y or "").strip()) for k in f.kinds) for f, x, y in zip(fields, a, b, strict=True)) / sum(f.weight for f in fields)
        if s >= least:
            want[frozenset((a, b))] = s
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert len(want) > 10


def test_fields_without_a_least_are_no_keys(spark):
    fields = [Field("name", weight=9.0), Field("words", ("Set",))]
    with pytest.raises(ValueError, match="words"):
        linkage.similar_records(spark.createDataFrame(people(), SCHEMA), fields, [("words",)], 80.0)


def test_pairs_grow_with_rows_not_with_blocks(spark):
    """A tenth of the rows has one nation and one name that differs by numbers only."""

    def pairs(n):
        rows = [(i, f"customer number {i * 7919 % 1000003:07d}", "XX" if i % 10 == 0 else f"N{i % 97}") for i in range(n)]
        df = spark.createDataFrame(rows, "id long, name string, nation string")
        fields = [Field("name"), Field("nation", ("Exact",))]
        records = linkage.with_node(df, fields)
        return linkage.candidates(records, fields, [("name", "nation")], 98.5).count()

    few, many = pairs(500), pairs(2000)
    assert many <= 8 * max(few, 250)


def test_increments_equal_clusters_at_once(spark):
    rows = people(120) + [(7, "anna schmidt", "blue", "10"), (None, "lone wolf pack", "blue", "1"), (None, "lone wolf packs", "blue", "1")]
    fields, keys = [Field("name", weight=3.0), Field("words", ("Set",))], [("name",)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", k int")
    at_once = sorted(((r.k, r.id, r.cluster_id) for r in linkage.clusters(df, "id", fields, keys, 85.0).collect()), key=str)
    state = linkage.clusters(df.filter("k % 3 = 1"), "id", fields, keys, 85.0)
    for part in (2, 0):
        state = linkage.extended(state, df.filter(f"k % 3 = {part}"), "id", fields, keys, 85.0)
    assert sorted(((r.k, r.id, r.cluster_id) for r in state.collect()), key=str) == at_once
    assert len(at_once) == len(rows) and len({c for _, _, c in at_once}) < len(rows)
    empty = linkage.extended(linkage.clusters(df.limit(0), "id", fields, keys), df.limit(0), "id", fields, keys)
    assert empty.count() == 0 and "cluster_id" in empty.columns


def test_survivors(spark):
    rows = [
        (1, "a@b.c", "+1 234 567 8901", "2020-01-05", "x"), (1, "a@b.c", "12", "2021-03-01", "yy"), (1, "no mail", "12", "never", "x"), (1, "no mail", None, None, "yy"), (1, "no mail", "", "2020-12-31", None),
        (2, "none", None, "soon", "a"), (2, "none", None, "soon", "b"), (3, None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "c long, mail string, phone string, day string, v string")
    got = {r.c: tuple(r)[1:] for r in linkage.survivors(df, "c", {"mail": "email", "phone": "phone", "day": "date", "v": "value"}).collect()}
    assert got == {1: ("a@b.c", "+1 234 567 8901", "2021-03-01", "yy"), 2: ("none", None, "soon", "a"), 3: (None, None, None, None)}


def test_weights_are_recovered():
    r = random.Random(5)
    m, u, share, n = [0.95, 0.8, 0.9], [0.01, 0.2, 0.05], 0.02, 400_000
    counts, chance = Counter(), Counter()
    for k in range(n):
        p = m if r.random() < share else u
        pattern = tuple(r.random() < x if i or r.random() < 0.9 else None for i, x in enumerate(p))
        counts[pattern] += 1
        chance[pattern] += k % 10 == 0
    model = linkage.fitted(sorted(counts.items(), key=str), sorted(chance.items(), key=str), n)
    assert abs(model.share - share) < 0.002
    assert all(abs(a - b) < 0.02 for a, b in zip(model.m + model.u, m + u, strict=True))
    assert linkage.fitted([], [], 0).share == 0.0


def test_one_to_one_is_greedy(spark):
    from plumbline.sources.scratch import Workspace

    r = random.Random(9)
    pairs = sorted({(r.randrange(40), r.randrange(40)): float(r.randrange(8)) for _ in range(300)}.items())
    want, us, vs = [], set(), set()
    for (u, v), s in sorted(pairs, key=lambda x: (-x[1], x[0])):
        if u not in us and v not in vs:
            want.append((u, v, s))
            us.add(u), vs.add(v)
    with Workspace(spark) as space:
        got = linkage.one_to_one(spark.createDataFrame([(*k, s) for k, s in pairs], "u long, v long, score double"), space)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert linkage.one_to_one(spark.createDataFrame([], "u long, v long, score double"), space).count() == 0


def test_planted_links_are_found(spark):
    left, right = queries.link_sides(spark, SF)
    found, model = linkage.link(left, right, "left_id", "right_id", queries.LINK_FIELDS, queries.LINK_KEYS)
    pairs = [tuple(r)[:2] for r in found.collect()]
    true = [p for p in pairs if p[1] == 3 * p[0] + 1]
    assert len(true) >= 0.9 * right.count() and len(true) >= 0.98 * len(pairs)
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    # planted: a fifth of the names, a thirteenth of the nations and a ninth of the segments wrong
    assert all(math.isclose(a, b, abs_tol=0.08) for a, b in zip((model.m[0], model.m[1], model.m[3]), (0.8, 0.92, 0.89), strict=True))
    plan = linkage.link_candidates(linkage.link_records(left, right, "left_id", "right_id", ["name", "balance"]), queries.LINK_KEYS, 90.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    none = linkage.link(left.limit(0), right.limit(0), "left_id", "right_id", queries.LINK_FIELDS, queries.LINK_KEYS)[0]
    assert none.count() == 0


def test_candidates_share_two_grams(spark):
    """One gram in common is no pair where edits leave two."""
    rows = [(i, f"{i * 7919 % 1000003:07d} {i * 104729 % 999983:07d}", "XX") for i in range(600)]
    df, fields = spark.createDataFrame(rows, "id long, name string, nation string"), [Field("name"), Field("nation", ("Exact",))]
    records = linkage.with_node(df, fields)
    assert linkage.candidates(records, fields, [("name", "nation")], 95.0).count() < 600


def test_tokens_of_one_side_are_no_pairs(spark):
    left, right = queries.link_sides(spark, SF)
    records = linkage.link_records(left, right, "left_id", "right_id", ["name", "balance"])
    plan = linkage.link_candidates(records, queries.LINK_KEYS, 90.0)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"side#\d+ < side#\d+", plan)


def test_weak_grams_are_compared_in_blocks(spark):
    rows, fields = people(), [Field("name", weight=3.0), Field("words", ("Exact",))]
    records = linkage.with_node(spark.createDataFrame(rows, SCHEMA), fields).dropDuplicates(["node"])
    assert linkage._block(records, fields, ("name", "words"), 80.0) == ["words"]
    assert linkage._block(records, fields, ("name", "words"), 95.0) == []
    met = {(r.u, r.v): round(r.score, 6) for r in linkage.within_blocks(records, ["words"], fields, 80.0).collect()}
    by_tokens = linkage.scored_pairs(records, linkage.candidates(records, fields, [("name", "words")], 80.0), fields, 80.0).collect()
    assert met == {(r.u, r.v): round(r.score, 6) for r in by_tokens} and len(met) > 10


def _numbered(n):
    """Records of three nations whose names differ by a few digits, an empty one and one with other characters."""
    r = random.Random(11)
    rows = [(i, f"customer {r.randrange(400):04d} é {r.randrange(60):03d}{'x' * (i % 3)}", f"N{i % 3}") for i in range(n)]
    return [*rows, (n, "", "N0"), (n + 1, None, "N1"), (n + 2, "\U0001f600", "N1")]


NUMBERED = "id long, name string, nation string"


def _by_plain(rows, least):
    """Scores of pairs of different contents by their smallest ids."""
    first = {}
    for i, name, nation in rows:
        first.setdefault((name, nation), i)
    want = {}
    for ((a, m), i), ((b, n), j) in itertools.combinations(first.items(), 2):
        score = (3 * plain("ShortString", a or "", b or "") + 100) / 4
        if m == n and score >= least:
            want[min(i, j), max(i, j)] = round(score, 6)
    return want


@pytest.mark.parametrize("part, least", [(1_000, 92.0), (40, 92.0), (40, 85.0)])
def test_tiles_find_all_pairs(spark, monkeypatch, part, least):
    monkeypatch.setattr(linkage.tiles, "PART", part)
    rows, fields = _numbered(300), [Field("name", weight=3.0), Field("nation", ("Exact",))]
    found = linkage.similar_records(spark.createDataFrame(rows, NUMBERED), fields, [("name", "nation")], least, id_col="id")
    # no tokens are exchanged, so no plan holds them
    assert "token" not in found._jdf.queryExecution().toString()
    want = _by_plain(rows, least)
    got = [((r.u, r.v), round(r.score, 6)) for r in found.collect()]
    assert sorted(got) == sorted(want.items()) and len(want) > 100


def test_tiles_give_components_few_links(spark, monkeypatch):
    """Of a dense block's pairs only those that hold it together, however many there are."""
    monkeypatch.setattr(linkage.tiles, "PART", 60)
    rows, fields, keys = _numbered(300), [Field("name", weight=3.0), Field("nation", ("Exact",))], [("name", "nation")]
    df = spark.createDataFrame(rows, NUMBERED)
    records = linkage.with_node(df, fields).select("node", "name", "nation").dropDuplicates(["node"])
    everything, few = (linkage._similar(records, fields, keys, 85.0, None, spanning=s).select("u", "v") for s in (False, True))
    assert few.count() <= 2 * 2 * len(rows) < everything.count() and few.exceptAll(everything).count() == 0
    both = [sorted(map(tuple, linkage.connected_components(x).collect())) for x in (everything, few)]
    assert both[0] == both[1]
    named = {r.id: r.cluster_id for r in linkage.clusters(df, "id", fields, keys, 85.0).collect()}
    assert all(named[u] == named[v] for u, v in _by_plain(rows, 85.0)) and len(named) == len(rows)


def test_tiles_of_two_sides(spark, monkeypatch):
    """New records meet stored ones in tiles, stored ones do not meet each other."""
    monkeypatch.setattr(linkage.tiles, "PART", 30)
    rows, fields, keys = _numbered(300), [Field("name", weight=3.0), Field("nation", ("Exact",))], [("name", "nation")]
    df = spark.createDataFrame(rows, NUMBERED)
    records = df.groupBy("name", "nation").agg(F.min("id").alias("node")).withColumn("side", (F.col("node") % 4 == 0).cast("int"))
    found = linkage._similar(records, fields, keys, 92.0, None)
    assert "token" not in found._jdf.queryExecution().toString()
    got = sorted((r.u, r.v) for r in found.select("u", "v").collect())
    assert got == sorted((u, v) for u, v in _by_plain(rows, 92.0) if (u % 4 == 0) != (v % 4 == 0)) and len(got) > 50
    at_once = sorted(map(tuple, linkage.clusters(df, "id", fields, keys, 92.0).select("id", "cluster_id").collect()))
    grown = linkage.extended(linkage.clusters(df.filter("id % 4 <> 0"), "id", fields, keys, 92.0), df.filter("id % 4 = 0"), "id", fields, keys, 92.0)
    assert sorted(map(tuple, grown.select("id", "cluster_id").collect())) == at_once


def test_pairs_under_ids_that_repeat_or_miss(spark, monkeypatch):
    """Tiles and tokens name records alike: by their smallest id, none of itself."""
    rows = _numbered(120) + [(None, "customer 0001 é 001", "N0"), (7, "customer 0001 é 002", "N0"), (7, "customer 0001 é 003", "N0")]
    df, fields, keys = spark.createDataFrame(rows, NUMBERED), [Field("name", weight=3.0), Field("nation", ("Exact",))], [("name", "nation")]
    found = {}
    for worth in (1, 1_000_000):
        monkeypatch.setattr(linkage, "WORTH", worth)
        found[worth] = sorted((r.u, r.v, round(r.score, 6)) for r in linkage.similar_records(df, fields, keys, 92.0, id_col="id").collect())
    in_tiles, by_tokens = found.values()
    assert in_tiles == by_tokens and len(by_tokens) > 20 and all(u < v for u, v, _ in by_tokens)
