"""Hierarchies, cycles and increments."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import hierarchy
from plumbline.sources.scratch import scratch
from plumbline.streaming.increments import SliceStore


def reach(edges, roots):
    out = {}
    for r in roots:
        out[r, r], front = 0, [r]
        while front:
            after = []
            for x in front:
                for a, b in edges:
                    if a == x and (r, b) not in out:
                        out[r, b] = out[r, x] + 1
                        after.append(b)
            front = after
    return out


def test_descendants_and_closure(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("x", None), (None, "y"), ("a", "b")]
    edges += [(f"chain{i}", f"chain{i + 1}") for i in range(25)]
    df = spark.createDataFrame(edges, "parent string, child string")
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    roots = ["a", "n1", "n2", "chain0", "alone", "a", None]
    got = {(x.root, x.node): x.depth for x in hierarchy.descendants(df, spark.createDataFrame([(x,) for x in roots], "root string")).collect()}
    assert got == reach(real, ["a", "n1", "n2", "chain0", "alone"])
    want = {}
    for a in {x for x, _ in real}:
        for (_, b), d in reach(real, [a]).items():
            if d:
                want[a, b] = d
        back = [d + 1 for (_, b), d in reach(real, [a]).items() if (b, a) in real]
        if back:
            want[a, a] = min(back)
    ways = hierarchy.closure(df)
    assert {(x.ancestor, x.node): x.depth for x in ways.collect()} == want
    assert {x.node: x.length for x in hierarchy.in_cycles(ways).collect()} == {a: d for (a, b), d in want.items() if a == b}
    none = df.limit(0)
    assert hierarchy.closure(none).count() == 0 and hierarchy.descendants(none, spark.createDataFrame([], "root string")).count() == 0


def test_rollup_counts_a_node_once(spark):
    edges = spark.createDataFrame([("top", "l"), ("top", "r"), ("l", "leaf"), ("r", "leaf")], "parent string, child string")
    held = spark.createDataFrame([("leaf", 5), ("r", 2), ("other", 9)], "node string, v int")
    got = {x.root: (x.n, x.v) for x in hierarchy.rolled_up(edges, edges.select("parent").distinct(), held, ["v"]).collect()}
    assert got == {"top": (2, 7), "l": (1, 5), "r": (2, 7)}


def rows(n, seed=1):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    out = [(start + dt.timedelta(minutes=37 * i), r.choice(["a", "b", None]), r.choice([None, round(r.random() * 50, 2)])) for i in range(n)]
    return out + [(None, "a", 1.0)]


SCHEMA = "at timestamp, kind string, v double"


def collected(store):
    return sorted((tuple(x) for x in store.slices().collect()), key=str)


@pytest.mark.parametrize("compact", [False, True])
def test_increments_equal_one_batch(spark, compact):
    df = spark.createDataFrame(rows(400), SCHEMA)
    new = lambda: SliceStore(spark, scratch(spark), "at", "1 day", ["kind"], ["v"])
    whole, parts = new(), new()
    whole.add(df, 1)
    seen = [df.filter(F.col("at") < F.lit(f"2024-01-0{d}").cast("timestamp")) for d in (3, 6)] + [df]
    parts.add(seen[0], 1)
    parts.add(seen[1], 2)
    if compact:
        parts.compact()
        with pytest.raises(ValueError, match="part of the base"):
            parts.add(seen[1], 2)
    else:
        parts.add(df, 2)  # runs again, and sees more rows by now
        parts.add(seen[0], 1)
    parts.add(seen[2], 3)
    parts.add(df.limit(0), 4)
    parts.add(df, 5)  # nothing new
    assert collected(parts) == collected(whole)
    assert sum(x[2] for x in collected(whole)) == 400
    with pytest.raises(ValueError, match="part of the base" if compact else "before one that is stored"):
        SliceStore(spark, parts.path, "at", "1 day", ["kind"], ["v"]).add(df, 0)


def test_first_increment_reads_an_interval(spark):
    df = spark.createDataFrame(rows(400), SCHEMA)
    store = SliceStore(spark, scratch(spark), "at", "1 day", [], ["v"], first=(2, "days"))
    store.add(df, 1)
    last = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * 399)
    assert sum(x[1] for x in collected(store)) == sum(1 for at, _, _ in rows(400) if at and at > last - dt.timedelta(days=2))
    with pytest.raises(FileNotFoundError):
        SliceStore(spark, scratch(spark), "at", "1 day", [], ["v"]).slices()
