"""Ranked lexical search: posting lists in geometric blocks that are skipped by exact bounds.

``ranked`` gives each item its best documents by a BM25-like score in whole
numbers. A document's impact for a term is what one occurrence of the term in an
item adds to its score. Steps, all jobs over all documents:

1. every document becomes a vector of its terms that items ask for (``vectors``),
   from which N, L and each term's document count follow; then of impacts, with
   a code: the signs of CODE random projections of its impacts (``index``).
   Alike documents have alike codes.
2. each posting list is clustered by document similarity: its blocks are the
   cells of the code's first bits, as many bits as its length asks for (BLOCK
   documents a block on average; every term has its own).
3. the best documents of each list by impact are scored for every item that
   holds the term. The score at rank ``most`` is the item's floor: no document
   below it is in the result.
4. lists are left out whose highest impacts together stay below the floor; for
   the blocks of the others the coordinatewise maximum over the block's
   documents is kept, and a block is skipped only where this summary's score is
   below the floor. Documents of the blocks left are scored exactly.

Items are worked on in blocks of about ITEM_TERMS terms, whose vocabulary is sent
to the tasks; a block is a pass over the documents. All scores are exact and
the blocks change cost only, never results.

Edge cases: null texts have no terms; documents without terms count nowhere;
items without terms get no rows; repeated documents are documents each (equal
scores by ascending id, those without an id last); equal rows of items are one
item, and one id with several texts is one item for each text; empty tables
give no rows; columns other than ids and texts are not read. Very long texts
are read whole. A large group of copies shares a cell; its documents are scored
by row, in as many tasks as there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import LOWER, arrow_schema, bounded_batches, required, steps, stored
from plumbline.sources.scratch import Workspace

MOST = 20
#: Projections of a code; documents of a block on average; (item, term) pairs that one pass takes.
CODE, BLOCK, ITEM_TERMS = 16, 64, 500_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _INSIDE[_low : _high + 1] = False
_INDEX = "row long, doc_id long, code int, terms array<int>, impacts array<long>"


@dataclass
class Queries:
    """A block of items: item k has terms[start[k]:start[k + 1]], each ``times`` times; ``vocabulary`` names the terms."""

    vocabulary: list[str]
    start: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


def queries(rows: list) -> Queries:
    """From (item, terms with repeats) rows, in order."""
    vocabulary = sorted({t for r in rows for t in r.terms})
    number = {t: k for k, t in enumerate(vocabulary)}
    start, terms, times = [0], [], []
    for r in rows:
        found, n = np.unique([number[t] for t in r.terms], return_counts=True)
        terms.extend(found.tolist())
        times.extend(n.tolist())
        start.append(len(terms))
    return Queries(vocabulary, np.array(start), np.array(terms, np.int64), np.array(times, np.int64))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _lists(flat: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat, kind))


def _vectors(vocabulary):
    out = arrow_schema("doc_id long, n long, terms array<int>, tfs array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            for ids, texts in steps(batch.column(0).to_pylist(), batch.column(1)):
                data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
                inside = _INSIDE[data]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
                start, end = edge[0::2], edge[1::2]
                offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
                words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))
                ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
                doc = np.searchsorted(ends, start, side="right")
                n = np.bincount(doc, minlength=len(texts))
                term = np.asarray(pc.index_in(words, value_set=known).fill_null(-1)).astype(np.int64)
                key, tf = np.unique((doc * len(known) + term)[term >= 0], return_counts=True)
                size = np.bincount(key // max(1, len(known)), minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), _lists(key % max(1, len(known)), size, pa.int32()), _lists(tf, size, pa.int32())], schema=out)

    return run


def _index(weights, n_docs: int, n_terms: int):
    out = arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        planes = np.random.Generator(np.random.PCG64(13)).choice([-1.0, 1.0], (len(w), CODE))
        for batch in batches:
            terms, size = batch.column(3).flatten(), np.asarray(batch.column(3).value_lengths()).astype(np.int64)
            t, tf = np.asarray(terms).astype(np.int64), np.asarray(batch.column(4).flatten()).astype(np.int64)
            m = 75 + (25 * np.asarray(batch.column(2)).astype(np.int64) * n_docs) // n_terms
            impacts = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, size)))
            sums = np.add.reduceat(impacts[:, None] * planes[t], np.cumsum(size) - size) if len(size) else np.zeros((0, CODE))
            code = (sums > 0) @ (1 << np.arange(CODE))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.astype(np.int32)), batch.column(3), _lists(impacts, size, pa.int64())], schema=out)

    return run


def _scored(asked, vocabulary: int):
    """Exact scores of (document, items) rows."""
    out = arrow_schema("item int, row long, doc_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = asked.value
        for batch in batches:
            size = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            keys = np.repeat(np.arange(len(size)), size) * vocabulary + np.asarray(batch.column(2).flatten())
            impacts = np.append(np.asarray(batch.column(3).flatten()).astype(np.int64), 0)
            asks = np.asarray(batch.column(4).value_lengths()).astype(np.int64)
            doc, item = np.repeat(np.arange(len(size)), asks), np.asarray(batch.column(4).flatten()).astype(np.int64)
            # a few million comparisons at a time
            step = max(1, 2_000_000 // max(1, int(np.diff(q.start).max(initial=1))))
            for a in range(0, len(doc), step):
                d, i = doc[a : a + step], item[a : a + step]
                length = q.start[i + 1] - q.start[i]
                at = _ranges(q.start[i], length)
                want = np.repeat(d, length) * vocabulary + q.terms[at]
                place = np.searchsorted(keys, want)
                hit = keys[np.minimum(place, len(keys) - 1)] == want
                score = np.add.reduceat(np.where(hit, impacts[np.minimum(place, len(keys) - 1)], 0) * q.times[at], np.cumsum(length) - length)
                taken = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(score)], schema=out)

    return run


def _summaries(near, bits, vocabulary: int):
    """Coordinatewise maxima of blocks: (term, cell, coordinate, most), maxima of a batch first.

    near: start and coordinates of each term whose list is searched (none: not searched).
    """
    out = arrow_schema("term int, cell int, coordinate int, most long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, coordinates = near.value
        shift = CODE - bits.value
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
            terms, impacts = np.asarray(batch.column(1).flatten()).astype(np.int64), np.asarray(batch.column(2).flatten()).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            keys = doc * vocabulary + terms
            posting = np.flatnonzero(start[terms + 1] > start[terms])
            wide = start[terms[posting] + 1] - start[terms[posting]]
            for part in np.split(posting, np.searchsorted(np.cumsum(wide), np.arange(2_000_000, wide.sum(), 2_000_000))):
                t, d = terms[part], doc[part]
                length = start[t + 1] - start[t]
                c = coordinates[_ranges(start[t], length)]
                want = np.repeat(d, length) * vocabulary + c
                place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                hit = keys[place] == want if len(keys) else np.zeros(0, bool)
                cell = np.asarray(batch.column(0)).astype(np.int64)[d] >> shift[t]
                t, cell, c, most = np.repeat(t, length)[hit], np.repeat(cell, length)[hit], c[hit], impacts[place[hit]]
                order = np.lexsort((-most, c, cell, t))
                t, cell, c, most = t[order], cell[order], c[order], most[order]
                first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (cell[1:] != cell[:-1]) | (c[1:] != c[:-1]))))[: len(t)]
                yield pa.RecordBatch.from_arrays([pa.array(x[first].astype(np.int32)) for x in (t, cell, c)] + [pa.array(most[first])], schema=out)

    return run


def _members(near, bits):
    """(term, cell, row) of the lists that are searched."""
    out = arrow_schema("term int, cell int, row long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, _ = near.value
        shift = CODE - bits.value
        for batch in batches:
            size = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            terms = np.asarray(batch.column(2).flatten()).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            used = start[terms + 1] > start[terms]
            t, d = terms[used], doc[used]
            cell = np.asarray(batch.column(1)).astype(np.int64)[d] >> shift[t]
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(d))], schema=out)

    return run


def _essential(q: Queries, highest: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which (item, term) lists have to be searched: all but those whose highest impacts together stay below the floor."""
    of, most = q.of(), highest[q.terms] * q.times
    order = np.lexsort((most, of))
    total = np.cumsum(most[order])
    before = np.concatenate(([0], total))[q.start[:-1]]
    out = np.zeros(len(most), bool)
    out[order] = total - before[of[order]] >= np.maximum(floor[of[order]], 1)
    return out


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``most`` best documents: item, rank, document, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("doc_id", "text").filter("text is not null")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    asked = asked.select("item_id", F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms")).filter("size(terms) > 0")
    with Workspace(spark) as space:
        asked = space.stored(asked.withColumn("key", F.monotonically_increasing_id()), "items")
        total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
        blocks = max(1, -(-total // ITEM_TERMS))
        parts = []
        for b in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("key").collect()
            if rows:
                parts.append(stored(_best(texts, rows, most, space, asked.schema["item_id"].dataType.simpleString()), "ranked"))
                space.free("vectors", "index", "seeds")
        if not parts:
            none = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
            return none.withColumnsRenamed({"item_id": item_col, "doc_id": id_col})
        result = parts[0]
        for p in parts[1:]:
            result = result.unionByName(p)
        return result.withColumnsRenamed({"item_id": item_col, "doc_id": id_col})


def _best(texts: DataFrame, rows: list, most: int, space: Workspace, item_type: str) -> DataFrame:
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    q = queries(rows)
    size = len(q.vocabulary)
    vectors = texts.mapInArrow(_vectors(share(q.vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>").filter("n > 0")
    vectors = space.stored(vectors.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "n", "terms", "tfs"), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    held = np.zeros(size, np.int64)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    index = space.stored(vectors.filter("size(terms) > 0").mapInArrow(_index(share(weights), n_docs, n_terms or 1), _INDEX), "index")
    queried = share(q)

    def scored(found: DataFrame) -> DataFrame:
        """Scores of (item, row) pairs, each pair once."""
        by_row = found.groupBy("row").agg(F.collect_set("item").alias("items"))
        return index.join(by_row, "row").select("row", "doc_id", "terms", "impacts", "items").mapInArrow(_scored(queried, size), "item int, row long, doc_id long, score long")

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    item_terms = spark.createDataFrame(
        pa.table({"item": pa.array(q.of().astype(np.int32)), "term": pa.array(q.terms.astype(np.int32)), "times": pa.array(q.times)}).to_pandas(), "item int, term int, times long"
    )
    postings = index.select("row", "doc_id", F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select("row", "doc_id", F.col("p.terms").alias("term"), F.col("p.impacts").alias("impact"))
    first = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    tops = space.stored(postings.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most), "seeds")
    highest = np.zeros(size, np.int64)
    for term, impact in tops.filter("place = 1").select("term", "impact").collect():
        highest[term] = impact
    floor = np.zeros(len(q), np.int64)
    seeds = scored(tops.select("row", "term").join(item_terms.select("item", "term"), "term"))
    for item, score in seeds.withColumn("place", F.row_number().over(best)).filter(F.col("place") == most).select("item", "score").collect():
        floor[item] = score

    essential = _essential(q, highest, floor)
    of = q.of()
    searched = spark.createDataFrame(
        pa.table({"item": pa.array(of[essential].astype(np.int32)), "term": pa.array(q.terms[essential].astype(np.int32)), "floor": pa.array(np.maximum(floor, 1)[of[essential]])}).to_pandas(),
        "item int, term int, floor long",
    )
    # the coordinates that a searched list's summaries need: the terms of items that search it
    length = np.diff(q.start)[of[essential]]
    pairs = np.unique(np.stack((np.repeat(q.terms[essential], length), q.terms[_ranges(q.start[of[essential]], length)])), axis=1)
    near = share((np.searchsorted(pairs[0], np.arange(size + 1)), pairs[1]))
    bits = share(np.clip(np.ceil(np.log2(np.maximum(held, 1) / BLOCK)), 0, CODE).astype(np.int64))
    summaries = index.select("code", "terms", "impacts").mapInArrow(_summaries(near, bits, size), "term int, cell int, coordinate int, most long")
    summaries = summaries.groupBy("term", "cell", "coordinate").agg(F.max("most").alias("most"))
    wanted = searched.join(item_terms.withColumnRenamed("term", "coordinate"), "item")
    bound = summaries.join(wanted, ["term", "coordinate"]).groupBy("item", "term", "cell", "floor").agg(F.sum(F.col("most") * F.col("times")).alias("bound"))
    left = bound.filter(F.col("bound") >= F.col("floor")).select("item", "term", "cell")
    members = index.select("row", "code", "terms").mapInArrow(_members(near, bits), "term int, cell int, row long")
    result = scored(members.join(left, ["term", "cell"]).select("item", "row")).filter("score > 0")
    result = result.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], f"item int, item_id {item_type}")
    return result.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
    d AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) WHERE len(ts) > 0),
    s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
    p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
    i AS (SELECT doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS impact FROM p JOIN w ON w.term = p.term, s),
    f AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM i JOIN q ON q.term = i.term GROUP BY 1, 2)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= {MOST}"""
