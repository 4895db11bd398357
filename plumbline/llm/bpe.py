"""BPE encoding and decoding with content-defined chunk reuse.

A rolling (Rabin-Karp) hash over 48 bytes cuts each text where the content
says so; the cut moves on to the next character start. Chunks that stand in
several texts are encoded once, by the text with the smallest name (its owner;
a name is a 128-bit hash), and their ids travel to the others. A text that
stands as a whole in several documents is encoded once: its result goes to
every row that holds it. Work is keyed by texts; ids only label the rows.

Chunks are encoded without their surroundings, so joins are repaired: the text
between the nearest places before and after a cut where a word certainly ends
is encoded again, and the piece grows outwards until its ends agree with token
ends of the chunks on both sides (at worst it is the whole text). What is
joined is therefore exactly what encoding the whole text gives.

Edge cases: null text counts as empty and gives no ids; special tokens written
in a text are encoded as the vocabulary file says; very long texts are cut
like others; texts without any word end are encoded whole; every row gives one
row, so repeated rows, null ids and one id on several texts each count, and
equal texts give equal results; an empty table gives no rows; columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import _BYTE, arrow_schema, bounded_batches, mix, powers, required, stored
from plumbline.sources.scratch import Workspace

#: Pre-tokens of byte-level BPE: the published pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes under the rolling hash, mean and least length of a chunk.
ROLLING, MEAN_CHUNK, LEAST_CHUNK = 48, 1024, 128
_CACHED = 400_000
_U = np.uint64


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encoding and decoding with one vocabulary file (of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(c.isspace() for t in added for c in t):
            raise ValueError("special tokens with white space are not supported")
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self._core = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pieces = regex.compile(PATTERN)
        self._special = {t: (i,) for t, i in added.items()}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = 1 + max([*ranks.values(), *added.values()])
        self.bytes_of = [b""] * size
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.bytes_of[i] = t
        self.decimal = [str(i) for i in range(size)]
        self.length = np.array([len(t) for t in self.bytes_of], np.int64)
        self._cache: dict[str, tuple[int, ...]] = {}

    def _ordinary(self, text: str, ids: list[int]) -> None:
        cache = self._cache
        for piece in self._pieces.findall(text):
            try:
                ids += cache[piece]
            except KeyError:
                got = tuple(self._core.encode_ordinary(piece))
                ids += got
                if len(piece) <= 48:
                    if len(cache) >= _CACHED:
                        cache.clear()
                    cache[piece] = got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self._split is None:
            self._ordinary(text, ids)
            return ids
        for part in self._split.split(text):
            if part in self._special:
                ids += self._special[part]
            elif part:
                self._ordinary(part, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder for each Python worker and vocabulary."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(raw)
    if n < 2 * LEAST_CHUNK:
        return [n]
    data = np.frombuffer(raw, np.uint8)
    up, down = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    rolling = mix((prefix[ROLLING:] - prefix[:-ROLLING]) * down[: n - ROLLING + 1])
    ends, last = [], 0
    for p in (np.flatnonzero(rolling < _U(2**64 // MEAN_CHUNK)) + ROLLING).tolist():
        while p < n and raw[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST_CHUNK and n - p >= LEAST_CHUNK:
            ends.append(p)
            last = p
    return [*ends, n]


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def name(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True


def joined(raw: bytes, ends: list[int], encoded: list[list[int]], code: Coder) -> list[int]:
    """The ids of the whole text from those of its chunks."""
    if len(ends) == 1:
        return encoded[0]
    data = np.frombuffer(raw, np.uint8)
    sure = np.concatenate(([0], np.flatnonzero(_BREAK[data[1:]] & _GRAPH[data[:-1]]) + 1, [len(raw)]))
    starts = [0, *ends[:-1]]
    token_ends = [np.concatenate(([0], np.cumsum(code.length[ids]))) + s for ids, s in zip(encoded, starts, strict=True)]

    def at(k: int, place: int) -> int | None:
        """The token index of a place in chunk k, if a token begins there."""
        i = int(np.searchsorted(token_ends[k], place))
        return i if i < len(token_ends[k]) and token_ends[k][i] == place else None

    out: list[int] = []
    k, begin = 0, 0  # the tokens of chunk k from begin on are not out yet
    while k < len(ends) - 1:
        lo = int(np.searchsorted(sure, ends[k], "right")) - 1
        hi = int(np.searchsorted(sure, ends[k]))
        # leftwards to a place that chunk k agrees on, or to all that is not out yet
        floor = int(token_ends[k][begin])
        while sure[lo] > floor and at(k, sure[lo]) is None:
            lo -= 1
        a = max(int(sure[lo]), floor)
        j = k + 1
        while True:  # rightwards to a place that its chunk agrees on, or to the end
            b = int(sure[hi])
            while b > ends[j] or (b == ends[j] and j < len(ends) - 1):
                j += 1
            i = at(j, b)
            if i is not None or b == len(raw):
                break
            hi += 1
        out += encoded[k][begin : at(k, a)]
        out += code.encode(raw[a:b].decode()) if a < b else []
        k, begin = j, len(encoded[j]) if i is None else i
    return out + encoded[k][begin:]


def _text(cell) -> bytes:
    return cell or b""


def _chunk_rows():
    """One row per row of the table, with its text's name, and one per chunk of a text of several."""
    out = arrow_schema("text binary, name binary, id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                raw = _text(raw)
                text = name(raw)
                rows.append((text, None, i))
                parts = chunks(raw)
                if len(parts) > 1:
                    rows += [(text, x, None) for x in {name(p) for p in parts}]
            yield _batch(rows, out)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _packed():
    out = arrow_schema("text binary, packed binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = map(_text, batch.column(0).cast(pa.binary()).to_pylist())
            yield _batch([(name(t), pack(t)) for t in texts], out)

    return run


_DONE = "kind int, text binary, name binary, ids binary, packed binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(ids: list[int], code: Coder) -> tuple[int, str, str]:
    decimal = ",".join(map(code.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(code.decode(ids).encode()).hexdigest()


def _encoded(path: str):
    """Kind 0: a finished text; 1: a shared chunk's ids, from its owner; 2: a text that waits for such."""
    out = arrow_schema(_DONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, unpack = coder(path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            for text, packed, own, waits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack(packed)
                size += len(raw)
                if not own and not waits:
                    rows.append((0, text, None, None, None, *_result(code.encode(raw.decode()), code)))
                else:
                    own, ends, parts = set(own or ()), cuts(raw), chunks(raw)
                    ids = []
                    for p in parts:
                        mine = name(p)
                        ids.append(code.encode(p.decode()) if mine in own or not waits else None)
                        if mine in own:
                            own.discard(mine)
                            rows.append((1, None, mine, np.array(ids[-1], np.uint32).tobytes(), None, None, None, None))
                    if waits:
                        rows.append((2, text, None, None, packed, None, None, None))
                    else:
                        rows.append((0, text, None, None, None, *_result(joined(raw, ends, ids, code), code)))
                if size > 4 << 20:
                    yield _batch(rows, out)
                    rows, size = [], 0
            yield _batch(rows, out)

    return run


def _completed(path: str):
    out = arrow_schema("text binary, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, unpack = coder(path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for k, (text, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = unpack(packed)
                got = {x["name"]: np.frombuffer(x["ids"], np.uint32).tolist() for x in batch.column(2)[k].as_py() or ()}
                ids = [got[x] if (x := name(p)) in got else code.encode(p.decode()) for p in chunks(raw)]
                rows.append((text, *_result(joined(raw, cuts(raw), ids, code), code)))
            yield _batch(rows, out)

    return run


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text.

    Returns id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text).
    """
    bounded_batches(docs.sparkSession)
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text")
    with Workspace(docs.sparkSession) as space:
        return stored(_results(texts, vocabulary, space), "encoded").withColumnRenamed("id", id_col)


_RESULT = "text binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _results(texts: DataFrame, vocabulary: str, space: Workspace) -> DataFrame:
    named = space.stored(texts.mapInArrow(_chunk_rows(), "text binary, name binary, id long"), "named")
    parts = named.filter("name is not null").select("text", "name")
    owners = parts.groupBy("name").agg(F.min("text").alias("owner"), F.max("text").alias("last")).filter("owner < last").select("name", "owner")
    marks = space.stored(
        parts.join(owners, "name").groupBy("text").agg(
            F.collect_set(F.when(F.expr("owner = text"), F.col("name"))).alias("own"),
            F.collect_set(F.when(F.expr("owner < text"), F.col("name"))).alias("waits"),
        ),
        "marks",
    )
    # equal names are equal texts, whichever comes first
    packed = texts.select("text").mapInArrow(_packed(), "text binary, packed binary").groupBy("text").agg(F.first("packed").alias("packed"))
    first = space.stored(packed.join(marks, "text", "left").select("text", "packed", "own", F.expr("size(waits) > 0").alias("waits")).mapInArrow(_encoded(vocabulary), _DONE), "encoded")
    space.drop_shuffles()

    wanted = marks.select("text", F.explode("waits").alias("name"))
    given = first.filter("kind = 1").select("name", "ids")
    sent = wanted.join(given, "name").groupBy("text").agg(F.collect_list(F.struct("name", "ids")).alias("parts"))
    later = first.filter("kind = 2").select("text", "packed").join(sent, "text", "left").mapInArrow(_completed(vocabulary), _RESULT)
    results = ["n_tokens", "ids_sha256", "decoded_sha256"]
    done = first.filter("kind = 0").select("text", *results).unionByName(later)
    return named.filter("name is null").select("id", "text").join(done, "text").select("id", *results)
