"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (powers of two).
Every item is represented by its smallest hashes (a bottom-k MinHash sketch);
k follows from its size n: the ``n - ceil(n * percent / 100)`` shingles that a
containing document may lack, and as many more as the partition asks hits for.
So a document that contains ``percent`` of an item, however long it is, has at
least that many hashes of the sketch. A document is held against a partition
only if it is large enough for its least item; what has the hits is verified
by exact containment of the item's shingles.

Documents are scanned, never shuffled. Items go to the tasks in blocks of at
most BLOCK_SHINGLES hashes (8 bytes each), one scan a block and one block at a
time, so driver and executors hold one block whatever the number of items.
What matches, and the rows' ids and text hashes, meet in one join, whether
there is one block or many.

Edge cases: null text counts as empty; an item without words is in no document;
an item of fewer than ``k`` words is one shingle of all its words, sought as
such; items without an id are not sought; an item id counts once a document;
every row gives a row, also where ids repeat, have several texts or are null;
empty tables give no matches; columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import arrow_schema, bounded_batches, hash_of_text, hashed_words, required, steps, stored, window_hashes
from plumbline.sources.scratch import Workspace

SHINGLE = 5
CONTAINED_PERCENT = 75
BLOCK_SHINGLES = 1_000_000


def _item_sets(k: int):
    out = arrow_schema("item long, width int, tokens array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in steps(batch.column(0).to_pylist(), batch.column(1)):
                words, at = hashed_words(raw, lower=True)
                rows = []
                for i, lo, hi in zip(ids, at[:-1], at[1:], strict=True):
                    if hi > lo:
                        width = min(k, int(hi - lo))
                        rows.append((i, width, np.unique(window_hashes(words[lo:hi], width)).view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return run


class Partition:
    """Items of one shingle width and one power of two of set sizes: the sketches' hashes in one sorted table."""

    def __init__(self, width: int, power: int, sets: list[tuple[int, np.ndarray]], percent: int):
        self.width = width
        self.hits = 1 + (1 << power) // 16
        self.least = min(-(-len(x) * percent // 100) for _, x in sets)
        keys, owners, asked = [], [], {}
        for i, x in sets:
            lacking = len(x) - -(-len(x) * percent // 100)
            sketch = min(len(x), lacking + self.hits)
            asked[i] = sketch - lacking
            keys.append(x[:sketch])
            owners.append(np.full(sketch, i))
        self.asked = asked
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]

    def candidates(self, doc: np.ndarray, shingle: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) with hits enough; ``doc`` and ``shingle`` hold each document's distinct shingles."""
        left = np.minimum(np.searchsorted(self.key, shingle), len(self.key) - 1)
        hit = np.flatnonzero(self.key[left] == shingle)
        if not len(hit):
            return []
        count = np.searchsorted(self.key, shingle[hit], "right") - left[hit]
        at = np.repeat(left[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pairs, found = np.unique(np.column_stack((np.repeat(doc[hit], count), self.owner[at])), axis=0, return_counts=True)
        return [(d, i) for (d, i), n in zip(pairs.tolist(), found.tolist(), strict=True) if n >= self.asked[i]]


class Items:
    """One block of items in their partitions."""

    def __init__(self, rows: list[tuple[int, int, list[int]]], percent: int):
        self.percent = percent
        self.ids = [r[0] for r in rows]
        self.sets = [np.sort(np.array(r[2], np.int64).view(np.uint64)) for r in rows]
        members: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, (_, width, _) in enumerate(rows):
            members[width, len(self.sets[i]).bit_length() - 1].append((i, self.sets[i]))
        self.partitions: dict[int, list[Partition]] = defaultdict(list)
        for (width, power), sets in sorted(members.items(), key=lambda x: x[0]):
            self.partitions[width].append(Partition(width, power, sets, percent))

    def matches(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Document index and item id of each containment."""
        found = []
        for width, partitions in self.partitions.items():
            own = [np.unique(window_hashes(words[lo:hi], width)) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            size = np.array([len(x) for x in own])
            for p in partitions:
                large = np.flatnonzero(size >= p.least)
                if not len(large):
                    continue
                doc = np.repeat(large, size[large])
                for d, i in p.candidates(doc, np.concatenate([own[x] for x in large])):
                    tokens = self.sets[i]
                    place = np.minimum(np.searchsorted(own[d], tokens), len(own[d]) - 1)
                    if 100 * int((own[d][place] == tokens).sum()) >= self.percent * len(tokens):
                        found.append((d, self.ids[i]))
        return found


_MATCHES = "id long, h long, item long"


def _matched(items):
    out = arrow_schema(_MATCHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw in steps(list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), batch.column(1)):
                words, at = hashed_words(raw, lower=True)
                rows = [(*own[d], item) for d, item in items.value.matches(words, at)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return run


def _blocks(rows) -> Iterator[list[tuple[int, int, list[int]]]]:
    block, held = [], 0
    for r in rows:
        if block and held + len(r.tokens) > BLOCK_SHINGLES:
            yield block
            block, held = [], 0
        block.append((r.item, r.width, r.tokens))
        held += len(r.tokens)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, percent: int = CONTAINED_PERCENT) -> DataFrame:
    """The items that each document contains: id, text_hash (with the id it tells rows apart),
    contaminated, n_items, item_ids (sorted, joined by commas)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text").withColumn("h", hash_of_text("text"))
    items = required(benchmark, **{item_col: "long", item_text_col: "string"}).toDF("id", "text").filter("id is not null")
    sets = items.mapInArrow(_item_sets(k), "item long, width int, tokens array<long>")
    with Workspace(spark) as space:
        found = spark.createDataFrame([], _MATCHES)
        for i, block in enumerate(_blocks(sets.toLocalIterator())):
            sent = spark.sparkContext.broadcast(Items(block, percent))
            found = found.unionByName(space.stored(texts.select("id", "text", "h").mapInArrow(_matched(sent), _MATCHES), f"block{i}"))
            sent.destroy()
        matches = stored(found.groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("items")), "matches")
    rows, m = texts.select("id", "h").alias("r"), matches.alias("m")
    both = rows.join(m, F.expr("r.h = m.h and r.id <=> m.id"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<long>")))
    return both.select(
        F.col("r.id").alias(id_col),
        F.col("r.h").alias("text_hash"),
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("item_ids"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark
), its AS (
  SELECT DISTINCT item_id, least(5, len(ws)) AS width, unnest([array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(5, len(ws)) + 2)]) AS s
  FROM iw WHERE len(ws) > 0
), sizes AS (SELECT item_id, count(*) AS n FROM its GROUP BY 1),
widths AS (SELECT DISTINCT width FROM its),
ds AS (
  SELECT DISTINCT id, width, unnest([array_to_string(ws[i : i + width - 1], ' ') FOR i IN range(1, len(ws) - width + 2)]) AS s
  FROM w, widths WHERE len(ws) >= width
), hits AS (
  SELECT ds.id, its.item_id FROM ds JOIN its ON ds.s = its.s AND ds.width = its.width
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (SELECT n FROM sizes z WHERE z.item_id = its.item_id)
), per_doc AS (SELECT id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, p.n IS NOT NULL AS contaminated, CAST(coalesce(p.n, 0) AS BIGINT) AS n_items, coalesce(p.items, '') AS item_ids
FROM documents d LEFT JOIN per_doc p ON p.id = d.doc_id
"""
