"""Substring dedup by recompression.

Each round names pairs of neighbouring symbols (and, first, runs of one word).
A name is a 64-bit hash of what it stands for, so the same pair has the same
name in every document and task without an exchange. In a round every symbol
is a left or a right one (one bit of its hash with the round's salt); a left
symbol followed by a right one makes a pair. Every symbol carries the interval
of words that its making depends on (its certificate), so equal windows hold
equal interior symbols, wherever they stand. A window is represented by the
highest symbol whose certificate lies inside it (of several by that with the
least name); windows in a row with one representative make a block, and so do
windows in a row that repeat one period of up to half a window (a run of one
word, or of what later rounds would name as one symbol), so a text that says
the same again and again is few blocks. Naming by hash gives what
naming by a global table would give, the same name to the same pair everywhere,
so that the rounds of one text need no exchange. Spark then works on blocks,
keyed by their symbols:

1. keys that stand in one document only leave (aggregated before the shuffle);
2. blocks equal to a block of a smaller document mark all their windows;
3. where a smaller document has the key but not the block, the windows of one
   representative per distinct block are hashed and compared (verification).

Edge cases: null text has no words; texts with fewer than ``width`` words lose
nothing; repeats inside one document stay; equal texts are judged by id; rows
of one id are one document, whether they repeat a text or have others, and each
of them gives a row; rows without an id lose nothing and no row loses anything
to them; an empty table gives no rows; columns other than id and text are not
read. Windows are compared by 128 bits. Very long texts are named whole, one a
step.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import arrow_schema, bounded_batches, hash_of_text, hashed_words, mix, range_hashes, required, signed, steps, stored
from plumbline.sources.scratch import Workspace

WIDTH = 50
_U = np.uint64
_MOST_ROUNDS = 40
#: ``h`` is the hash of the text: with the id it tells rows apart.
_ANCHORS = "key long, block long, id long, h long, first int, last int"
_WINDOWS = "key long, win long, id long, h long, at int"
_KEPT = "id long, h long, n_words long, n_removed long, kept string"


def _runs(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name the runs of one word: the symbols, and where each begins."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(sym))).astype(np.uint64)
    return np.where(count > 1, mix(sym[start] + count * _U(0xD6E8FEB86659FD93)), sym[start]), start


def levels(words: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols and certificates [lo, hi) of each round, until no certificate has ``most`` words or fewer.

    ``at`` has where each document's words begin, and the end. What depends on
    where a document begins or ends has a certificate reaching over that end.
    """
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    sym, lo = mix(words + _U(1)), np.arange(len(words), dtype=np.int64)
    yield sym, lo, lo + 1
    sym, lo = _runs(sym, doc)
    hi = np.append(lo[1:], len(words)) + 1  # that a run ends is known from the words beside it
    doc, lo = doc[lo], lo - 1
    yield sym, lo, hi
    for turn in range(_MOST_ROUNDS):
        if not len(sym) or (hi - lo > most).all():
            return
        n = len(sym)
        right = (mix(sym + _U(turn + 2)) >> _U(63)).astype(bool)
        same = np.zeros(n + 1, bool)
        same[1:n] = doc[1:] == doc[:-1]
        opens = np.zeros(n, bool)
        opens[:-1] = ~right[:-1] & right[1:] & same[1:n]
        closes = np.zeros(n, bool)
        closes[1:] = opens[:-1]
        # a pair depends on its halves; a single symbol on the neighbour that might have made a pair with it
        head = np.flatnonzero(~closes)
        pair = opens[head]
        nxt = np.minimum(head + 1, n - 1)
        beside = np.where(pair | ~right[head], nxt, np.maximum(head - 1, 0))
        inside = np.where(right[head], same[head], same[head + 1])
        edge = np.where(right[head], lo[head] - 1, lo[head])
        plo = np.where(inside, np.minimum(lo[head], lo[beside]), edge)
        phi = np.where(inside, np.maximum(hi[head], hi[beside]), hi[head] + ~right[head])
        sym = np.where(pair, mix(sym[head] * _U(3) + mix(sym[nxt] + _U(5))), sym[head])
        lo, hi, doc = plo, phi, doc[head]
        yield sym, lo, hi


def blocks(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Blocks of windows: document, key, block hash, first and last window (counted in the document).

    A window is represented by the highest symbol whose certificate it holds,
    of several by that with the least name, of equal ones by the leftmost.
    """
    n, count = len(words), max(len(words) - width + 1, 0)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    open_ = doc[:count] == doc[width - 1 :] if count else np.zeros(0, bool)
    key, place = np.zeros(count, np.uint64), np.full(count, -1, np.int64)
    # windows that repeat a short period (one word: a run): those that stand in a row are one block, named by the words of
    # the period whatever their turn; the least period is what the window's words alone tell
    run, one = np.zeros(count, bool), np.zeros(count, bool)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + _U(9)), dtype=np.uint64)))
    for p in range(1, width // 2 + 1) if open_.any() else ():
        breaks = np.concatenate(([0], np.cumsum(words[p:] != words[:-p])))
        hit = open_ & (breaks[:count] == breaks[width - p :])
        if hit.any():
            begins = np.flatnonzero(hit)
            key[begins], place[begins] = mix(total[begins + p] - total[begins] + _U(p * 0xC2B2AE3D27D4EB4F % (1 << 64))), breaks[begins]
            run |= hit
            open_ &= ~hit
            one = run.copy() if p == 1 else one
    for sym, lo, hi in list(levels(words, at, width))[::-1] if open_.any() else ():
        left = np.concatenate(([0], np.cumsum(open_)))
        if not left[-1]:
            break
        first, last = np.clip(hi - width, 0, count), np.minimum(lo, count - 1)
        use = np.flatnonzero((last >= first) & (left[np.maximum(last, first - 1) + 1] > left[first]))
        use = use[np.lexsort((-lo[use], ~sym[use]))]  # the last assignment holds: least name, leftmost
        each = last[use] - first[use] + 1
        start = np.repeat(first[use] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        who = np.repeat(use, each)
        free = open_[start]
        start, who = start[free], who[free]
        key[start], place[start] = sym[who], lo[who]
        open_[start] = False
    cut = np.ones(count, bool)
    cut[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (doc[1:count] != doc[: max(count - 1, 0)])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], count)
    real = place[begin] >= 0
    begin, end = begin[real], end[real]
    offset = np.where(run[begin], 0, place[begin] - begin).astype(np.uint64)
    content = np.where(one[begin], mix(key[begin]), mix(range_hashes(words, begin, end - 1 + width) + offset * _U(0x9E3779B1)))
    base = at[doc[begin]]
    return doc[begin], key[begin], content, begin - base, end - 1 - base


def _anchor_rows(width: int):
    out = arrow_schema(_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw in steps(list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), batch.column(1)):
                words, at = hashed_words(raw, lower=False)
                doc, key, content, first, last = blocks(words, at, width)
                rows = [signed(key), signed(content), *np.array(own, np.int64)[doc].T, first, last]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(rows, out, strict=True)], schema=out)

    return run


def _window_rows(width: int):
    """Hashes of the windows of the blocks asked for: one row per window."""
    out = arrow_schema(_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            k = 0
            for ids, raw in steps(list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), batch.column(1)):
                words, at = hashed_words(raw, lower=False)
                keys, starts, own = [], [], []
                for i in range(len(ids)):
                    for w in wanted[k].as_py():
                        span = np.arange(w["first"], w["last"] + 1)
                        starts.append(span + at[i])
                        keys.append(np.full(len(span), w["key"], np.int64))
                        own.append(np.full(len(span), i, np.int64))
                    k += 1
                if not starts:
                    continue
                start, doc = np.concatenate(starts), np.concatenate(own)
                win = range_hashes(words, start, start + width, seed=7)
                rows = [np.concatenate(keys), signed(win), *np.array(ids, np.int64)[doc].T, start - at[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(rows, out, strict=True)], schema=out)

    return run


def _kept_rows(width: int):
    out = arrow_schema(_KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw, h, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = (raw or b"").split()
                n = len(words)
                marks = marks.as_py() or []
                if marks:
                    step = np.zeros(n + width + 1, np.int64)
                    np.add.at(step, [m["first"] for m in marks], 1)
                    np.add.at(step, [m["last"] + width for m in marks], -1)
                    keep = np.cumsum(step)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                rows.append((i, h, n, n - len(words), b" ".join(words).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)] if rows else [pa.array([], f.type) for f in out], schema=out)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Remove words covered by a window of ``width`` words that also starts in a document with a smaller id.

    Returns id, text_hash (of the text that came in: with the id it tells rows apart),
    n_words, n_removed and kept (the remaining words joined by one space).
    """
    bounded_batches(docs.sparkSession)
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text").withColumn("h", hash_of_text("text"))
    with Workspace(docs.sparkSession) as space:
        marks = stored(_marks(texts.filter("id is not null"), width, space), "marks")
    return (
        texts.join(marks, ["id", "h"], "left")
        .select("id", "text", "h", "marks")
        .mapInArrow(_kept_rows(width), _KEPT)
        .withColumnsRenamed({"id": id_col, "h": "text_hash"})
    )


def _marks(texts: DataFrame, width: int, space: Workspace) -> DataFrame:
    """Of each row that loses words: the first and last windows that are to go (id, h, marks)."""
    found = space.stored(texts.mapInArrow(_anchor_rows(width), _ANCHORS), "found")
    # keys of two documents or more, and the occurrences of those
    several = found.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    shared = space.stored(found.join(several, "key"), "shared")
    space.free("found")
    space.drop_shuffles()
    by_block = space.stored(shared.groupBy("key", "block").agg(F.min(F.struct("id", "h")).alias("least"), F.max("id").alias("most")), "blocks")
    equal = (
        shared.join(by_block.filter("least.id < most").select("key", "block", F.col("least.id").alias("least")), ["key", "block"])
        .filter("id > least")
        .select("id", "h", "first", "last")
    )

    # a smaller document has the key in another block: compare windows, one occurrence a block
    open_keys = by_block.groupBy("key").count().filter("count > 1").select("key")
    least = by_block.join(open_keys, "key").select("key", "block", "least.id", "least.h")
    asked = shared.join(least, ["key", "block", "id", "h"]).select("id", "h", F.struct("key", "first", "last").alias("w"))
    lists = asked.groupBy("id", "h").agg(F.collect_set("w").alias("wanted"))
    windows = space.stored(texts.join(lists, ["id", "h"]).select("id", "text", "h", "wanted").mapInArrow(_window_rows(width), _WINDOWS), "windows")
    by_window = windows.groupBy("key", "win").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "win", "least")
    single = windows.join(by_window, ["key", "win"]).filter("id > least").select("id", "h", F.col("at").alias("first"), F.col("at").alias("last"))
    return equal.unionByName(single).groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("marks"))


def digests(deduped: DataFrame) -> DataFrame:
    """The query's columns: the kept text as a SHA-256."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
