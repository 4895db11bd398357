"""Phrase collocations: counts by multikey three-way quicksort of suffix pointers.

A suffix pointer stands at each word of a piece and reads the words that follow,
DEPTH at most. Three passes, each a job over all texts:

1. words are counted by language (each batch counts first). Words of fewer than
   ``least`` occurrences can begin or end no frequent phrase.
2. the pointers at frequent words are routed by language and leading word;
   batches send equal pointers once, with their number, those of a bucket packed
   in one row. Where the leading word is very frequent (HOT), the second takes
   part in the routing, and where both are, the third, so that a frequent word
   or pair is dealt over many tasks (such a pair goes once more by itself, as one
   pointer a batch, and is counted where that goes). A third word that is infrequent ends the
   pointer: no phrase that holds it counts.
3. each bucket of about BUCKET pointers is sorted by multikey three-way
   quicksort, breadth first: every open partition is split by a pivot of its
   own into less, equal and greater, the equal part goes on with the next word,
   and its weight is the count of the phrase read so far. Partitions lighter
   than ``least`` are abandoned, whichever part they are.

Which words are frequent or HOT is sent to the tasks as two bitmaps of FILTER
bits, a fixed size; a word that meets a frequent one's bit is routed for
nothing and abandoned later, one that meets a HOT one's bit is routed by more
words, in every task alike. Counts are exact; words are told apart by their
text, never by a hash.

Pointers that are routed by one word or pair are fewer than HOT, so a bucket is
bounded; ranks are taken within hashed parts of a language before the whole.

Edge cases: null and empty texts have no pieces; a null language is ``und``;
repeated rows count as often as they stand; equal scores go by count and then
by the phrase's bytes; an empty table gives no rows; columns other than text and
language are not read. Very long texts are read whole: a batch holds one text
at least, and pieces never span texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import LOWER, arrow_schema, bounded_batches, mix, required, span_hashes, stored
from plumbline.sources.scratch import Workspace

DEPTH = 3
#: Occurrences of a candidate, and how many of each language are returned.
LEAST, MOST = 10, 2000
#: A candidate goes where a longer one makes up so many percent of its occurrences.
COVERED = 50
#: Bits of the word filters; occurrences from which a word is hot; pointers of a bucket; parts of a language that are ranked first.
FILTER, HOT, BUCKET, PARTS = 1 << 24, 100_000, 1 << 19, 64

_WORD, _BLANK, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _CUT
_NONE = -1


def words_and_pieces(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts in order, and the number of the piece that each stands in."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    inside = kind == _WORD
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))
    return words, np.cumsum(kind == _CUT)[start] if len(start) else np.zeros(0, np.int64)


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    langs = batch.column(0).dictionary_encode()
    texts = np.array(batch.column(1).cast(pa.binary()).to_pylist(), object)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, texts[np.asarray(langs.indices) == k].tolist()


def _places(words: pa.Array) -> np.ndarray:
    """The bit of the filters that each word has."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, offset=words.offset * 4)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    hashes = span_hashes(data, offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64))
    return (hashes & np.uint64(FILTER - 1)).astype(np.int64)


def _counted():
    """A row for each language and word of a batch, and one without a word for all of them."""
    out = arrow_schema("lang string, word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in by_language(batch):
                words, _ = words_and_pieces(texts)
                if len(words):
                    coded = words.dictionary_encode()
                    n = np.bincount(coded.indices, minlength=len(coded.dictionary))
                    found = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), found, pa.array(np.append(n, len(words)))], schema=out)

    return run


def _bits():
    out = arrow_schema("slot long, bit long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], schema=out)

    return run


def word_filter(words: DataFrame) -> np.ndarray:
    """A bitmap of FILTER bits with those of the given words set (the driver gets at most FILTER / 64 rows)."""
    bits = np.zeros(FILTER // 64, np.int64)
    for slot, word in words.mapInArrow(_bits(), "slot long, bit long").groupBy("slot").agg(F.bit_or("bit")).collect():
        bits[slot] = word
    return bits.view(np.uint8)


def _is_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: Pointers of one bucket, language and batch: the words of each (the third empty where the pointer has ended), a line a word, and how often it stands.
_POINTERS = "bucket int, lang string, split boolean, words binary, weights binary"


def _routed(frequent, hot, buckets: int):
    """Pointers by bucket; frequent and hot are broadcast bitmaps."""
    out = arrow_schema(_POINTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for lang, texts in by_language(batch):
                words, piece = words_and_pieces(texts)
                if len(words) < 2:
                    continue
                coded = words.dictionary_encode()
                known, codes, size = coded.dictionary, np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
                at = _places(known)
                usual, very = _is_set(frequent.value, at)[codes], _is_set(hot.value, at)
                pointer = np.flatnonzero(usual[:-1] & usual[1:] & (piece[:-1] == piece[1:]))
                if not len(pointer):
                    continue
                third = np.minimum(pointer + 2, len(codes) - 1)
                goes_on = (pointer + 2 < len(codes)) & (piece[third] == piece[pointer]) & usual[third]
                read, weight = _distinct(np.stack((codes[pointer], codes[pointer + 1], np.where(goes_on, codes[third], size))), size + 1)
                split = very[read[0]] & very[read[1]]
                # pairs whose pointers are dealt by three words go once more by themselves, to be counted in one place
                pair, at_pair = np.unique(read[0, split] * size + read[1, split], return_inverse=True)
                read = np.concatenate((read, np.stack((pair // size, pair % size, np.full(len(pair), size)))), axis=1)
                weight = np.concatenate((weight, np.bincount(at_pair, weight[split], len(pair)).astype(np.int64)))
                split = np.concatenate((split, np.zeros(len(pair), bool)))
                bucket = _bucket(lang, np.append(at, FILTER).astype(np.uint64)[read], very[read[0]], split, buckets)
                order = np.lexsort((split, bucket))
                read, weight, split, bucket = read[:, order], weight[order], split[order], bucket[order]
                lines = pc.binary_join_element_wise(pa.concat_arrays([known, pa.array([""])]).take(pa.array(read.T.ravel())), "", "\n")
                ends = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1)[::3]
                data = memoryview(lines.buffers()[2])
                first = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (split[1:] != split[:-1]))))
                last = np.append(first[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[first].astype(np.int32)),
                        pa.array([lang] * len(first)),
                        pa.array(split[first]),
                        pa.array([pack(data[ends[i] : ends[j]]) for i, j in zip(first, last, strict=True)], pa.binary()),
                        pa.array([pack(weight[i:j].tobytes()) for i, j in zip(first, last, strict=True)], pa.binary()),
                    ],
                    schema=out,
                )

    return run


def _bucket(lang: str, places: np.ndarray, hot_first: np.ndarray, split: np.ndarray, buckets: int) -> np.ndarray:
    """By language and first word; by the second too where the first is hot, by all three where both are."""
    name = np.frombuffer(f"{lang} ".encode(), np.uint8)
    route = span_hashes(name, np.array([0]), np.array([len(name)])) + places[0] * np.uint64(0x9E3779B97F4A7C15)
    route = route + np.where(hot_first, places[1] * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
    route = route + np.where(split, places[2] * np.uint64(0x165667B19E3779F9), np.uint64(0))
    return (mix(route) % np.uint64(buckets)).astype(np.int64)


def _distinct(read: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal columns of ``read`` (codes below ``size``) once, with their number."""
    if size < 2_000_000:
        key, n = np.unique((read[0] * size + read[1]) * size + read[2], return_counts=True)
        return np.stack((key // (size * size), key // size % size, key % size)), n.astype(np.int64)
    found, n = np.unique(read, axis=1, return_counts=True)
    return found, n.astype(np.int64)


def three_way_sorted(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers, breadth first, one split of all open partitions a round.

    ``keys`` has a row for each depth and a column for each pointer (_NONE:
    the pointer has ended). Yields (depth, one pointer of each equal partition,
    the partition's weight), for partitions of ``least`` at least; the others are
    abandoned. Ended pointers take no part in deeper partitions.
    """
    order = np.arange(keys.shape[1])
    part = np.zeros(len(order), np.int64)
    depth = np.zeros(1, np.int64)
    random = np.random.Generator(np.random.PCG64(7))
    while len(order):
        size = np.bincount(part, minlength=len(depth))
        first = np.cumsum(size) - size
        key = keys[depth[part], order]
        pivot = key[first + (random.random(len(size)) * size).astype(np.int64)]
        side = np.where(key < pivot[part], 0, np.where(key == pivot[part], 1, 2))
        child = 3 * part + side
        weights = np.bincount(child, weight[order], 3 * len(depth)).astype(np.int64)
        ends = np.repeat(pivot == _NONE, 3) & (np.arange(3 * len(depth)) % 3 == 1)
        stays = (weights >= least) & ~ends
        equal = np.flatnonzero(stays[1::3])
        if len(equal):
            inner = np.flatnonzero(side == 1)
            sample = np.zeros(len(depth), np.int64)
            sample[part[inner]] = order[inner]
            for d in np.unique(depth[equal]):
                of = equal[depth[equal] == d]
                yield int(d), sample[of], weights[3 * of + 1]
        stays[1::3] &= depth + 1 < len(keys)
        kept = stays[child]
        order, child = order[kept], child[kept]
        number = np.cumsum(stays) - 1
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        depth, part = deeper[stays], number[child]
        moved = np.argsort(part, kind="stable")
        order, part = order[moved], part[moved]


def _sorted_bucket(least: int):
    out = arrow_schema("lang string, w1 string, w2 string, w3 string, f long")

    def run(bucket: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        read = [unpack(x) for x in bucket.column("words").to_pylist()]
        weights = [np.frombuffer(unpack(x), np.int64) for x in bucket.column("weights").to_pylist()]
        data = np.frombuffer(b"".join(read), np.uint8)
        line = data == 0x0A
        offsets = np.concatenate(([0], np.flatnonzero(line) + 1 - np.arange(1, line.sum() + 1))).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~line].tobytes())).dictionary_encode()
        known, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64).reshape(-1, DEPTH).T
        ended = pc.index(known, "").as_py()
        codes = np.where(codes == ended, _NONE, codes)
        each = [len(w) for w in weights]
        langs = bucket.column("lang").combine_chunks().dictionary_encode()
        keys = np.concatenate((np.repeat(np.asarray(langs.indices).astype(np.int64), each)[None], codes))
        weight, split = np.concatenate(weights), np.repeat(np.asarray(bucket.column("split")), each)
        rows = []
        # of pointers dealt by three words only whole phrases are counted here
        for which, shortest in ((np.flatnonzero(~split), 2), (np.flatnonzero(split), 3)):
            for depth, sample, total in three_way_sorted(keys[:, which], weight[which], least):
                if depth >= shortest:
                    at = which[sample]
                    w = [known.take(pa.array(keys[d, at])) for d in range(1, depth + 1)]
                    third = w[2] if depth == 3 else pa.nulls(len(at), pa.string())
                    rows.append(pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys[0, at])), w[0], w[1], third, pa.array(total)], schema=out))
        return pa.Table.from_batches(rows, schema=out)

    return run


def phrase_counts(docs: DataFrame, least: int, space: Workspace, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n; without a word: all of the language) and phrases of two and three words (lang, w1, w2, w3, f) of ``least`` occurrences."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = required(docs, **{lang_col: "string", text_col: "string"}).toDF("lang", "text").filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = texts.mapInArrow(_counted(), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = space.stored(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    total = words.filter("word is null").agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(word_filter(words.filter("word is not null").select("word")))
    hot = spark.sparkContext.broadcast(word_filter(words.filter((F.col("n") >= HOT) & F.col("word").isNotNull()).select("word")))
    buckets = max(1, total // BUCKET)
    pointers = texts.mapInArrow(_routed(frequent, hot, buckets), _POINTERS)
    found = pointers.groupBy("bucket").applyInArrow(_sorted_bucket(least), "lang string, w1 string, w2 string, w3 string, f long")
    return words, space.stored(found, "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in decimals of 38 digits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score."""
    with Workspace(docs.sparkSession) as space:
        words, phrases = phrase_counts(docs, least, space, lang_col, text_col)
        single = words.filter("word is not null")
        pairs, triples = phrases.filter("w3 is null"), phrases.filter("w3 is not null")

        def count_of(name: str, **key: str) -> DataFrame:
            """Words' counts as ``name``, by language and the given column."""
            (column,) = key.values()
            return single.select("lang", F.col("word").alias(column), F.col("n").alias(name))

        def pair_count(name: str, x: str, y: str) -> DataFrame:
            return pairs.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("f").alias(name))

        two = pairs.join(count_of("l", of="w1"), ["lang", "w1"]).join(count_of("r", of="w2"), ["lang", "w2"])
        inside = triples.select("lang", "w1", "w2", "f").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
        longer = inside.groupBy("lang", "w1", "w2").agg(F.max("f").alias("longest"))
        two = two.join(longer, ["lang", "w1", "w2"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < COVERED * F.col("f")))
        two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r", _score(F.col("f"), F.col("l"), F.col("r")).alias("score"))

        three = (
            triples.join(count_of("l1", of="w1"), ["lang", "w1"]).join(pair_count("r1", "w2", "w3"), ["lang", "w2", "w3"])
            .join(pair_count("l2", "w1", "w2"), ["lang", "w1", "w2"]).join(count_of("r2", of="w3"), ["lang", "w3"])
            .withColumn("s1", _score(F.col("f"), F.col("l1"), F.col("r1")))
            .withColumn("s2", _score(F.col("f"), F.col("l2"), F.col("r2")))
        )
        first = F.col("s1") <= F.col("s2")
        three = three.select(
            "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
            F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
        )
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        best = two.unionByName(three).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
        totals = words.filter("word is null").select("lang", "n")
        return stored(best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
    u AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(ws) AS w1 FROM w) GROUP BY 1, 2),
    b AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS f FROM (SELECT lang, unnest([ws[i:i+1] FOR i IN range(1, len(ws))]) AS x FROM w) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
    t AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS f FROM (SELECT lang, unnest([ws[i:i+2] FOR i IN range(1, len(ws) - 1)]) AS x FROM w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= {LEAST}),
    cuts AS (
        SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, l.f AS l, r.f AS r, 1 AS k FROM b JOIN u l ON l.lang = b.lang AND l.w1 = b.w1 JOIN u r ON r.lang = b.lang AND r.w1 = b.w2
        WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND ((t.w1 = b.w1 AND t.w2 = b.w2) OR (t.w2 = b.w1 AND t.w3 = b.w2)) AND 100 * t.f >= {COVERED} * b.f)
        UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, l.f, r.f, 1 FROM t JOIN u l ON l.lang = t.lang AND l.w1 = t.w1 JOIN b r ON r.lang = t.lang AND r.w1 = t.w2 AND r.w2 = t.w3
        UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, l.f, r.f, 2 FROM t JOIN b l ON l.lang = t.lang AND l.w1 = t.w1 AND l.w2 = t.w2 JOIN u r ON r.lang = t.lang AND r.w1 = t.w3),
    s AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
    c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM c JOIN (SELECT lang, sum(f) AS n FROM u GROUP BY 1) AS v ON v.lang = c.lang QUALIFY rank <= {MOST}"""
