"""Pairs of similar records with equal block fields, by comparing the block's records in tiles.

A block is dealt over parts, and every two parts meet in a group of a task, so
neither candidates nor keys of grams are exchanged: a record travels as often as
its block has parts. Within a group the common grams of all pairs are counted by
products of matrices, and pairs that have too few for the edits their lengths
allow are gone; the others' edit distances are computed, many at once.

Quadratic in a block, at a few nanoseconds a pair; memory is that of a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About how many records a part of a block has, and how many characters at most if all were as long as the longest.
PART, CHARACTERS = 32_000, 16_000_000
#: Columns of a matrix, how many pairs' common grams are counted together, and how many pairs' distances.
WIDTH, COUNTED, MEASURED = 128, 1 << 19, 1 << 14


def edits(longest, share: float):
    """How many edits leave a ratio of ``share`` to values of which the longer has that length."""
    return np.floor(longest * (1.0 - share) + 1e-9).astype(np.int64)


# ---------------------------------------------------------------- within a group


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters as small numbers, from 1 on, and 0 behind a value's end; lengths)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(lengths.max(initial=0)) or 1
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    known, numbers = np.unique(points, return_inverse=True)
    numbers = numbers.reshape(points.shape) + 1
    numbers[np.arange(width) >= lengths[:, None]] = 0
    return numbers.astype(np.uint8 if len(known) < 255 else np.uint16 if len(known) < 65_535 else np.uint32), lengths


def _counts(codes: np.ndarray, lengths: np.ndarray, q: int) -> tuple[np.ndarray, int]:
    """A matrix of q-grams whose products are at least as large as the number of common ones, and how many all rows have besides.

    A gram's second occurrence is another gram; rare ones share columns.
    """
    n, width = codes.shape[0], codes.shape[1] - q + 1
    if width < 1:
        return np.zeros((n, 1), np.float32), 0
    base = int(codes.max(initial=0)) + 1
    grams = sum(codes[:, i : i + width].astype(np.int64) * base**i for i in range(q))
    grams[np.arange(width) > (lengths - q)[:, None]] = -1
    grams.sort(axis=1)
    new = np.ones(grams.shape, bool)
    new[:, 1:] = grams[:, 1:] != grams[:, :-1]
    at = np.arange(width)
    turn = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
    rows, columns = np.nonzero(grams >= 0)
    known, which, n_rows = np.unique(grams[rows, columns] * width + turn[rows, columns], return_inverse=True, return_counts=True)
    everywhere = n_rows == n
    order = np.argsort(np.where(everywhere, -1, n_rows))[::-1]
    column = np.empty(len(known), np.int64)
    column[order] = np.where(np.arange(len(known)) < WIDTH // 2, np.arange(len(known)), WIDTH // 2 + np.arange(len(known)) % (WIDTH // 2))
    told = ~everywhere[which]
    filled = np.bincount(rows[told] * WIDTH + column[which[told]], minlength=n * WIDTH).reshape(n, WIDTH)
    used = filled.any(axis=0)
    return np.ascontiguousarray(filled[:, used], dtype=np.float32), int(everywhere.sum())


def _needed(lengths: np.ndarray, share: float, q: int, everywhere: int) -> np.ndarray:
    """How many common grams of a matrix a value's similar ones have at least.

    Values of at most ``longest`` characters with as many edits as that allows
    share longest - q + 1 - q * edits grams; a row's figure is the least of its own and greater lengths.
    """
    longest = np.arange(int(lengths.max(initial=0)) + 1)
    least = longest - q + 1 - q * edits(longest, share) - everywhere
    return np.minimum.accumulate(least[::-1])[::-1][lengths].astype(np.float32)


def _without_start(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values without the start that all share, which no distance depends on, a row for each place."""
    equal = (codes == codes[0]).all(axis=0)
    start = min(len(equal) if equal.all() else int(equal.argmin()), int(lengths.min()))
    return np.ascontiguousarray(codes[:, start:].T), lengths - start


def _distances(places: np.ndarray, lengths: np.ndarray, u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of values u and v, or something above ``most``: within a band about the diagonal, all pairs in step."""
    n_u, ahead = lengths[u], lengths[v] - lengths[u] + most
    steps, band = int(n_u.max()), 2 * most + 1
    kind = np.uint8 if steps + 2 * band < 255 and places.dtype == np.uint8 else np.int32
    a = places[:steps, u]
    # b[i + k] is the place of v that the band's k-th cell compares with place i of u; those outside are like none
    b = np.full((steps + band, len(u)), np.iinfo(places.dtype).max, places.dtype)
    held = min(len(places), steps + most + 1)
    b[most : most + held] = places[:held, v]
    far = kind(most + 1)
    row = np.repeat(np.maximum(np.arange(band) - most, 0).astype(kind)[:, None], len(u), axis=1)
    row[:most] = far
    found = np.full(len(u), most + 1, np.int64)
    other, after, near = np.empty((band, len(u)), bool), np.empty_like(row), np.empty_like(row)
    cells, shortest = np.arange(len(u)), int(n_u.min())
    for i in range(steps + 1):
        if i:
            np.not_equal(a[i - 1], b[i - 1 : i - 1 + band], out=other)
            np.add(row, other.view(np.uint8), out=after, casting="unsafe")
            np.add(row[1:], kind(1), out=near[1:])
            np.minimum(after[:-1], near[1:], out=after[:-1])
            if i <= most:
                # before the other value's first place
                after[: most - i] = far
                after[most - i] = i
            for k in range(1, band):
                np.add(after[k - 1], kind(1), out=near[0])
                np.minimum(after[k], near[0], out=after[k])
            row, after = after, row
        if i >= shortest:
            ends = cells[n_u == i]
            ends = ends[(ahead[ends] >= 0) & (ahead[ends] < band)]
            found[ends] = row[ahead[ends], ends]
    return found


class _Links:
    """Which rows hang together, and the pairs that made them do so."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int32)

    def joining(self, u: np.ndarray, v: np.ndarray) -> list[int]:
        """Of pairs those that join what did not hang together before."""
        up, kept = self.label, []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for at, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(at)
        while (self.label != self.label[self.label]).any():
            self.label = self.label[self.label]
        return kept


def _near(codes: np.ndarray, lengths: np.ndarray, share: float, left: np.ndarray, right: np.ndarray, links: _Links | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right row (each once where the two are the same) with enough common grams, many at once."""
    tried, same = [], left is right
    some = left[:: max(1, len(left) // 64)]
    for q in (1, 2):
        counts, everywhere = _counts(codes, lengths, q)
        need = _needed(lengths, share, q, everywhere)
        tried.append((int((counts[some] @ counts[right].T >= need[some, None]).sum()), q, counts, need))
    _, _, counts, need = min(tried, key=lambda t: t[:2])
    group, near_groups = _groups(codes, lengths, share)
    left = left[np.argsort(group[left], kind="stable")]
    right = left if same else right[np.argsort(group[right], kind="stable")]
    starts = np.searchsorted(group[right], np.arange(len(near_groups) + 1))
    for g, (start, stop) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        # where the two sides are the same the second record of a pair is one that stands behind
        met = np.flatnonzero(near_groups[g][group[left]] & (np.arange(len(left)) > start if same else True))
        rows, others, at = counts[left[met]], np.ascontiguousarray(counts[right[start:stop]].T), start
        # few others first: where most records hang together after them, little is left to be measured
        size = 64 if links else COUNTED // 64
        while at < stop and len(met):
            end = min(stop, at + size)
            step = max(1, COUNTED // (end - at))
            for first in range(np.searchsorted(met, at, "right") if same else 0, len(met), step):
                own = left[met[first : first + step]]
                near = rows[first : first + step] @ others[:, at - start : end - start] >= need[own, None]
                if links:
                    near &= links.label[own, None] != links.label[right[at:end]]
                u, v = np.divmod(np.flatnonzero(near), end - at)
                if same:
                    behind = met[u + first] > v + at
                    u, v = u[behind], v[behind]
                u, v = own[u], right[v + at]
                # the other value's length may ask for more
                close = np.abs(lengths[u] - lengths[v]) <= edits(np.maximum(lengths[u], lengths[v]), share)
                if close.any():
                    yield u[close], v[close]
            at, size = end, min(2 * size, COUNTED // 64)


def _groups(codes: np.ndarray, lengths: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's group, and which groups' values may be similar: by how often those characters stand in them that vary least."""
    n, most = len(codes), max(1, len(codes) // 256)
    rows, places = np.nonzero(np.arange(codes.shape[1]) < lengths[:, None])
    known, which = np.unique(codes[rows, places], return_inverse=True)
    group, held = np.zeros(n, np.int64), np.zeros((1, 0), np.int64)
    if len(known) > 4096:
        return group, np.ones((1, 1), bool)
    often = np.zeros((n, len(known)), np.int64)
    np.add.at(often, (rows, which), 1)

    def spread(x: np.ndarray) -> float:
        part = np.unique(x, return_counts=True)[1] / n
        return float(-(part * np.log(part)).sum())

    for column in sorted(range(len(known)), key=lambda c: spread(often[:, c])):
        finer, first, numbers = np.unique(group * (codes.shape[1] + 1) + often[:, column], return_index=True, return_inverse=True)
        if len(finer) > most:
            break
        held = np.column_stack([held[group[first]], often[first, column]])
        group = numbers
    more = np.maximum(held[:, None, :] - held[None, :, :], 0).sum(axis=2)
    return group, np.maximum(more, more.T) <= edits(int(lengths.max()), share)


def _batches(pairs: Iterator[tuple[np.ndarray, np.ndarray]], at_once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in runs of MEASURED; ``at_once`` keeps none for later ones to fill a run."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in pairs:
        kept.append(pair)
        if at_once or sum(len(u) for u, _ in kept) >= MEASURED:
            u, v = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept = []
            for at in range(0, len(u), MEASURED):
                yield u[at : at + MEASURED], v[at : at + MEASURED]
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _tile(table: pa.Table, shares: list[float], weights: list[tuple[float, bool]], least: float, spanning: bool, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a tile and their scores. ``weights``: each field's, and whether it is one of the block's."""
    own = table["own"].to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(own), np.flatnonzero(~own)
    if not across and table["i"][0] == table["j"][0]:
        right = left
    if not len(left) or not len(right):
        return
    values = [_codes(table[f"v{i}"].to_pylist()) for i in range(len(shares))]
    ends = [_without_start(*v) for v in values]
    links = _Links(len(own)) if spanning else None
    for u, v in _batches(_near(*values[0], shares[0], left, right, links), spanning):
        if links:
            apart = links.label[u] != links.label[v]
            u, v = u[apart], v[apart]
        alike: list[np.ndarray] = []
        for (_, lengths), end, share in zip(values, ends, shares, strict=True):
            if not len(u):
                break
            longest = np.maximum(lengths[u], lengths[v])
            limit = edits(longest, share)
            far = _distances(*end, u, v, int(limit.max()))
            close = far <= limit
            ratio = 100.0 * (1 - far / np.maximum(longest, 1))
            u, v, alike = u[close], v[close], [x[close] for x in [*alike, ratio]]
        if not len(u):
            continue
        score, each = np.zeros(len(u)), iter(alike)
        for weight, held in weights:
            score = score + weight * (100.0 if held else next(each))
        score = score / sum(w for w, _ in weights)
        good = np.flatnonzero(score >= least)
        if links and len(good):
            good = good[links.joining(u[good], v[good])]
        if len(good):
            yield u[good], v[good], score[good]


def _compared(*how) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        found = [(nodes[u], nodes[v], score) for u, v, score in _tile(table, *how)]
        u, v, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v), "score": score})

    return run


# ---------------------------------------------------------------- tiles


def compared(records: DataFrame, block: list[Column], values: dict[str, Column], shares: list[float], weights: list[tuple[float, bool]], least: float, spanning: bool = False) -> DataFrame:
    """(u, v, score) of all pairs of nodes with equal ``block`` whose mean similarity reaches ``least``; u < v.

    ``records``: node, and side (0 or 1) where only records of different sides
    are to be compared. ``values`` are the compared texts, ``shares`` the ratio that each has to reach.
    ``spanning``: only pairs that hold together what all pairs would, a tile at a time.
    """
    across = "side" in records.columns
    rows = records.select("node", (F.col("side") if across else F.lit(0)).cast("int").alias("side"), F.xxhash64(*block).alias("block"), *(v.alias(k) for k, v in values.items()))
    longest = F.greatest(F.lit(1), *(F.max(F.length(k)) for k in values))
    parts = F.ceil(F.greatest(F.count("*") / PART, F.count("*") * longest / CHARACTERS)).cast("int")
    counted = rows.groupBy("block", "side").agg(parts.alias("parts"))
    if across:
        other = counted.select("block", (1 - F.col("side")).alias("side"), F.col("parts").alias("others"))
        counted = counted.join(other, ["block", "side"])
        n_tiles = F.sum(F.col("parts") * F.col("others")) / 2
    else:
        counted = counted.withColumn("others", F.col("parts"))
        n_tiles = F.sum(F.col("parts") * (F.col("parts") + 1)) / 2
    # few rows are much work here: as many tasks as tiles, not as few as their bytes ask for
    tasks = records.sparkSession.sparkContext.defaultParallelism
    tasks = int(min(4000, max(tasks, 2 * (counted.agg(n_tiles).first()[0] or 0))))
    dealt = rows.join(counted, ["block", "side"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    if across:
        i, j, own = F.when(F.col("side") == 0, F.col("part")).otherwise(F.col("met")), F.when(F.col("side") == 0, F.col("met")).otherwise(F.col("part")), F.col("side") == 0
    else:
        i, j, own = F.least("part", "met"), F.greatest("part", "met"), F.col("part") <= F.col("met")
    tile = dealt.select("block", i.alias("i"), j.alias("j"), "node", own.alias("own"), *values)
    found = tile.repartition(tasks, "block", "i", "j").groupBy("block", "i", "j")
    return found.applyInArrow(_compared(shares, weights, least, spanning, across), "u long, v long, score double")
