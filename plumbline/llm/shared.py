"""What the operators of this subpackage share: reading tables, the shared
scratch folder, bounded Arrow batches and vectorised hashing of words.

Hashing works on the bytes of a whole Arrow batch at once with numpy: a
polynomial prefix sum modulo 2**64 gives the hash of every word from two
subtractions, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.scratch import scratch, stored  # noqa: F401

#: Rows and bytes of one Arrow batch; a batch is what a Python worker holds at once.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20
#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Python workers' memory bounded whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def required(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; others (and clashing names among them) go."""
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


# ---------------------------------------------------------------- hashing

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, STEP_BYTES + 65_536)
        fresh = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, _U(base))
            a[0] = 1
            fresh.append(np.cumprod(a, dtype=np.uint64))
        if n > 8 * STEP_BYTES:
            return fresh[0], fresh[1]
        _powers[:] = fresh
    return _powers[0], _powers[1]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a run of bytes without ASCII white space."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(symbols: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``width`` symbols (one for each start)."""
    if len(symbols) < width:
        return np.zeros(0, np.uint64)
    if width <= 8:
        total = np.zeros(len(symbols) - width + 1, np.uint64)
        for j in range(width):
            total += symbols[j : j + len(total)] * _U((2 * pow(_BASE, j + 1, 1 << 62) + 1) & (2**64 - 1))
        return mix(total + _U(seed))
    start = np.arange(len(symbols) - width + 1)
    return range_hashes(symbols, start, start + width, seed)


def range_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of symbols[start:end] for each pair."""
    up, down = powers(len(symbols))
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols + _U(seed)) * up[: len(symbols)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) + _U(seed))


def steps(ids: list, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Pieces of a batch with about STEP_BYTES of text: ids and UTF-8 texts (null: empty)."""
    own, raw, size = [], [], 0
    for i, t in zip(ids, texts.cast(pa.binary()).to_pylist(), strict=True):
        t = t or b""
        if own and size + len(t) > STEP_BYTES:
            yield own, raw
            own, raw, size = [], [], 0
        own.append(i)
        raw.append(t)
        size += len(t) + 1
    if own:
        yield own, raw


def hashed_words(raw: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    if lower:
        data = LOWER[data]
    start, end = words_of(data)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw)))
    return span_hashes(data, start, end), np.concatenate(([0], np.searchsorted(start, ends)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_of_text(column: str) -> F.Column:
    """Sixty-four bits of a text's content, JVM side."""
    return F.xxhash64(F.col(column))
