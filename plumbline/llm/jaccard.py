"""N-gram Jaccard join with token-combination prefixes (exact).

Tokens are 64-bit hashes of a document's distinct five-word shingles. All
tokens stand in one global order: rare ones first, then common ones by the
power of two that counts their documents, tokens of the frequent class last,
by hash among equals. So a passage that many documents share leaves the
prefixes of all but those that consist of it. A pair whose overlap reaches what
the threshold asks shares at least ``l`` tokens in prefixes that are extended
by ``l - 1`` tokens, so that:

* the rare and common tokens of an extended prefix are indexed one by one, the frequent
  ones by k-token combinations (k = 2): of the shared tokens either one is
  rare, or ``l`` frequent ones are shared, and then two of them fall into the
  same of ``l - 1`` groups by hash, so only combinations within a group are needed;
* a rare token of the prefix that no other document has cannot be shared. This
  bounds what a document can have in common with any other, and documents for
  which that is too little leave before any pair exists.

Candidate pairs are then drawn to one member of each posting list (never all
pairs of a list; first to the member that stands in most lists, as the origin
of near copies does) and verified by exact set overlap. What is left in
posting lists that still hold several components is drawn to further members
for some rounds, and at last between the components that still share a list.
There a pair comes to be only if it passes two bounds on the overlap: what is
left of either set from the position of the key on, and the parities of the
tokens' counts in 1024 cells, as the bits in which two sets differ are no more
than the tokens in which they differ. Links within one component are not
sought again, so no component is lost and none of its pairs is expanded.

Edge cases: null text counts as empty; a text without words has no tokens and
links with nothing; fewer than ``k`` words make one shingle; repeated rows and
identical token sets are one class from the start; ties go to the smaller id;
rows without an id link like others but never name a component (component_id
is null where no row of it has an id); an empty table gives no rows; columns other than id and text are not read.
Sets are told apart by 128 bits and named by 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import (
    arrow_schema,
    bounded_batches,
    hash_of_text,
    hashed_words,
    mix,
    required,
    signed,
    steps,
    stored,
    window_hashes,
)
from plumbline.operators.components import connected_components
from plumbline.sources.scratch import Workspace

SHINGLE = 5
THRESHOLD_PERCENT = 75
#: The most common tokens are listed, at most so many (nine bytes each are broadcast).
#: Which tokens are listed sets the order and the cost, never the result.
COMMON_LIST = 500_000
#: A token is common that stands in so many different documents, counted in blocks of
#: about BLOCK tokens where two documents of the block have it.
COMMON_LEAST = 4
BLOCK = 4_000_000
#: It is of the frequent class if it stands in this share of the documents of one block.
FREQUENT_SHARE = 0.01
FREQUENT_LEAST = 16
#: Added to the levels of the frequent class.
FREQUENT_LEVEL = 64
#: Extension of prefixes, as a part of the set's size.
EXTENSION = 0.06
#: Rounds of drawing candidates to one member of each posting list.
STAR_ROUNDS = 2
#: These rounds look at one key in so many; the last step looks at all.
STAR_KEYS = 4
#: In each of them a class is held against so many hubs, those with most keys in common.
STAR_TRIES = 3
#: Times that classes which cannot link leave the lists, which then get shorter.
TRIMS = 2
#: Longs of the parity bits that bound a pair's overlap.
PARITY_LONGS = 16

_PROFILE = "kind int, id long, h long, n long, a long, b long"
#: A key of a set's prefix; ``place`` is 4 * position + kind.
_PREFIX = "key long, cls long, n int, rare int, place int"
#: Kinds of keys: rare tokens, frequent ones, and combinations of these; the last
#: kind are combinations that only a smaller partner asks for.
RARE, SINGLE, COMBINED, FOR_SMALLER = range(4)
_PARITY = [f"p{i}" for i in range(PARITY_LONGS)]
_SETS = "cls long, n int, tokens binary, " + ", ".join(f"{p} long" for p in _PARITY)


def shingle_sets(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = hashed_words(raw, lower=True)
    shingles = window_hashes(words, k)
    for i in range(len(raw)):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= k:
            yield np.unique(shingles[lo : hi - k + 1])
        elif hi > lo:
            yield window_hashes(words[lo:hi], int(hi - lo), seed=int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def set_names(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = np.uint64(len(tokens)), np.uint64(0)
    if len(tokens):
        a = mix(mix(tokens + np.uint64(11)).sum(keepdims=True, dtype=np.uint64) + a)[0]
        b = mix(mix(tokens + np.uint64(77)).sum(keepdims=True, dtype=np.uint64) + a)[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity(tokens: np.ndarray) -> np.ndarray:
    """The parities of the tokens' counts in 64 * PARITY_LONGS cells, as longs."""
    cells = np.bincount((tokens % np.uint64(64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def needed(n: int, percent: int = THRESHOLD_PERCENT) -> int:
    """The least overlap of a set of n tokens with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def extension(n: int) -> int:
    """Shared prefix keys that a set of n tokens is asked for: grows with n, one at least."""
    return 1 + int(EXTENSION * n)


def _profiles(k: int):
    """Rows of kind 0: a document's set (id, hash of its text, size, two names); kind 1: tokens
    that several sets of a block have (token, count, 1 where it is of the frequent class)."""
    out = arrow_schema(_PROFILE)

    def batch_of(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def common(block: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(block), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        often = count >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(block))
        zero = np.zeros(len(token), np.int64)
        return batch_of(zero + 1, signed(token), zero, count, often.astype(np.int64), zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, seen = [], 0, set()
        for batch in batches:
            for rows, raw in steps(list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), batch.column(1)):
                sets = list(shingle_sets(raw, k))
                names = [set_names(x) for x in sets]
                ids, hashes = zip(*rows, strict=True)
                yield batch_of([0] * len(ids), ids, hashes, [len(x) for x in sets], [x[0] for x in names], [x[1] for x in names])
                for x, name in zip(sets, names, strict=True):
                    if len(x) and name not in seen:
                        seen.add(name)
                        block.append(x)
                        held += len(x)
                if held >= BLOCK:
                    yield common(block)
                    block, held, seen = [], 0, set()
        if held:
            yield common(block)

    return run


def levels(tokens: np.ndarray, listed: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The level of each token in the global order; 0 if it isn't listed."""
    if not len(listed):
        return np.zeros(len(tokens), np.uint8)
    at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
    return np.where(listed[at] == tokens, level[at], np.uint8(0))


def groups_of(asked: int) -> int:
    """Of ``asked`` tokens two fall into one of so many groups: a power of two below ``asked``."""
    return 1 << ((asked - 1).bit_length() - 1)


def combinations(tokens: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of tokens in one group each, and the index of the later token of each."""
    group = (mix(tokens ^ np.uint64(0xA5A5)) & np.uint64(groups - 1)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, held = group[order], tokens[order]
    keys, later = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in range(1, int(np.bincount(group).max(initial=0))):
        at = np.flatnonzero(group[step:] == group[:-step])
        keys.append(mix(held[at] * np.uint64(3) + mix(held[at + step]) + np.uint64(groups)))
        later.append(order[at + step])
    return np.concatenate(keys), np.concatenate(later)


def prefix_keys(tokens: np.ndarray, level: np.ndarray, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The keys of a set's extended prefix with their places, and how many are rare tokens.

    ``tokens`` are sorted, ``level`` holds the level of each. If the key of a combination is one
    that two linked sets are sure to have, its later token is one of the first ``extension(n)``
    that they share; its position is lowered by that, so that it bounds the overlap like a first one.
    """
    n = len(tokens)
    asked, least = extension(n), extension(needed(n, percent))
    order = np.argsort(level, kind="stable")[: min(n, n - needed(n, percent) + asked)]
    prefix, often = tokens[order], level[order] >= FREQUENT_LEVEL
    rare, common = prefix[~often], prefix[often]
    keys, places = [rare], [4 * np.arange(len(rare)) + RARE]
    if len(common) and least < 2:  # some partner is asked for one token only, which may be a frequent one
        keys.append(common)
        places.append(4 * (len(rare) + np.arange(len(common))) + SINGLE)
    for groups in {groups_of(x) for x in range(max(least, 2), asked + 1)} if len(common) > 1 else ():
        pairs, later = combinations(common, groups)
        keys.append(pairs)
        places.append(4 * np.maximum(len(rare) + later - (asked - 1), 0) + (COMBINED if groups == groups_of(asked) else FOR_SMALLER))
    return len(rare), np.concatenate(keys), np.concatenate(places)


def _prefixes(k: int, percent: int, common):
    out = arrow_schema(_PREFIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, level = common.value
        seen: set[int] = set()
        for batch in batches:
            for _, raw in steps([None] * batch.num_rows, batch.column(0)):
                rows, keys, places = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for tokens in shingle_sets(raw, k):
                    name = set_names(tokens)[0]
                    if len(tokens) and name not in seen:
                        seen.add(name)
                        rare, own, at = prefix_keys(tokens, levels(tokens, listed, level), percent)
                        rows.append((name, len(tokens), rare, len(own)))
                        keys.append(own)
                        places.append(at)
                if len(seen) > 500_000:
                    seen.clear()
                cls, n, rare, count = np.array(rows, np.int64).reshape(-1, 4).T
                columns = [signed(np.concatenate(keys)), *(np.repeat(c, count) for c in (cls, n, rare)), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def _token_sets(k: int):
    out = arrow_schema(_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in steps([None] * batch.num_rows, batch.column(0)):
                sets = list(shingle_sets(raw, k))
                bits = np.array([parity(x) for x in sets], np.int64).reshape(-1, PARITY_LONGS)
                columns = [[set_names(x)[0] for x in sets], [len(x) for x in sets], [x.tobytes() for x in sets], *bits.T]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def _overlaps(percent: int):
    out = arrow_schema("a long, b long, linked boolean")

    def linked(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(p) > len(q):
            p, q = q, p
        both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
        return 100 * both >= percent * (len(p) + len(q) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([linked(*p) for p in zip(x, y, strict=True)], pa.bool_())], schema=out)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each candidate pair with whether it links (the joins may be split where a hub is hot)."""
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_overlaps(percent), "a long, b long, linked boolean")


def _reaches(x: str, y: str, percent: int) -> F.Column:
    """Whether two postings of a key leave room for a link: a pair links if its overlap is at least
    (n_x + n_y) * percent / (100 + percent), and the overlap is ``most`` of either at most if the
    key is the one that the two are sure to share (their first common token if that is rare)."""
    asked = f"({x}kind < {FOR_SMALLER} or {y}kind < {FOR_SMALLER})"
    return F.expr(f"{asked} and {100 + percent} * least({x}most, {y}most) >= {percent} * ({x}n + {y}n)")


def _may_link(percent: int) -> F.Column:
    """Whether the bits in which sets x and y differ leave room for a link: at most
    (n_x + n_y) * (100 - percent) / (100 + percent) tokens of linked sets differ."""
    differ = " + ".join(f"bit_count(x_{p} ^ y_{p})" for p in _PARITY)
    return F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * (x_n + y_n)")


def _with_components(lists: DataFrame, links: DataFrame, space: Workspace) -> DataFrame:
    """Posting lists that still hold more than one component, with each member's
    component and the one that has most members in the list (``main``)."""
    comps = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = lists.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    held = named.groupBy("key", "comp").agg(F.count("*").alias("held"))
    mixed = held.groupBy("key").agg(F.max(F.struct("held", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1").select("key", F.col("most.comp").alias("main"))
    return space.stored(named.join(mixed, "key"), "mixed")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Link documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns per row of ``docs``: id, n_shingles (size of the set), component_id
    (the smallest id that links reach, itself included) and text_hash (with the
    id it tells rows apart).
    """
    bounded_batches(docs.sparkSession)
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text").withColumn("h", hash_of_text("text"))
    with Workspace(docs.sparkSession) as space:
        found = stored(_grouped(texts, k, percent, space), "components")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("h").alias("text_hash"))


def _grouped(texts: DataFrame, k: int, percent: int, space: Workspace) -> DataFrame:
    profile = space.stored(texts.mapInArrow(_profiles(k), _PROFILE), "profile")
    members = profile.filter("kind = 0").select("id", "h", "n", F.col("a").alias("cls"))
    listed = _common_tokens(profile)

    # posting lists: one exchange by key; only keys of two classes or more go on
    posted = texts.select("text").mapInArrow(_prefixes(k, percent, listed), _PREFIX)
    lists = space.stored(_shared_keys(posted), "lists")
    space.drop_shuffles()
    for turn in range(TRIMS):
        bounds = _bounds(lists, percent)
        rest = lists.join(bounds, "cls").dropDuplicates(["cls", "key"])
        lists = space.stored(_shared_keys(rest.drop("eff")), f"lists{turn}")
        space.free("lists" if not turn else f"lists{turn - 1}")
    bounded = lists.join(_bounds(lists, percent), "cls")
    lists = space.stored(bounded.select("key", "cls", "n", F.expr("place % 4").cast("byte").alias("kind"), F.expr("least(eff, n - place div 4)").cast("int").alias("most")), "bounded")
    space.free(f"lists{TRIMS - 1}")
    space.drop_shuffles()

    left = lists.select("cls").distinct()
    first = members.join(left, "cls").groupBy("cls").agg(F.min(F.struct("id", "h")).alias("one")).select("one.id", "one.h")
    one = texts.alias("t").join(first.alias("f"), F.expr("t.h = f.h and t.id <=> f.id"), "left_semi")
    sets = space.stored(one.select("text").mapInArrow(_token_sets(k), _SETS).dropDuplicates(["cls"]), "sets")

    tried, links = None, None
    some = lists.filter(f"pmod(key, {STAR_KEYS}) = 0")
    mixed = some.withColumn("comp", F.col("cls"))
    for turn in range(STAR_ROUNDS):
        if turn == 0:  # the member of most lists first
            ranked, order = mixed.join(mixed.groupBy("cls").agg(F.count("*").alias("lists")), "cls"), F.struct(-F.col("lists"), "cls")
        else:
            ranked, order = mixed, F.xxhash64(F.col("cls"), F.lit(turn))
        hub = F.struct(order.alias("o"), F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("kind").alias("hub_kind"), F.col("most").alias("hub_most"), F.col("comp").alias("other"))
        hubs = ranked.groupBy("key").agg(F.min(hub).alias("h")).select("key", "h.hub", "h.hub_n", "h.hub_kind", "h.hub_most", "h.other")
        drawn = mixed.join(hubs, "key").filter(F.expr("comp <> other") & _reaches("", "hub_", percent)).groupBy("cls", "hub").count()
        pairs = drawn.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"), "cls", "count")
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        by_class = Window.partitionBy("cls").orderBy(F.desc("count"), "a", "b")
        best = pairs.withColumn("try", F.row_number().over(by_class)).filter(F.col("try") <= STAR_TRIES).select("a", "b").distinct()
        checked = space.stored(_verified(best, sets, percent), "checked")
        tried = checked if tried is None else tried.unionByName(checked)
        links = tried.filter("linked")
        if turn == STAR_ROUNDS - 1 or checked.filter("linked").isEmpty():
            break
        mixed = _with_components(some, links, space)

    # whatever still shares a list across components: every such pair that the bounds leave;
    # members of a list's main component are only held against the others
    mixed = _with_components(lists, links, space).join(sets.select("cls", *_PARITY), "cls")
    x, y = (mixed.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "n", "kind", "most", "comp", "main", *_PARITY))) for s in "xy")
    rest = (
        x.filter("x_comp <> x_main")
        .join(y, "key")
        .filter(F.expr("x_comp <> y_comp and (y_comp = y_main or x_cls < y_cls)") & _reaches("x_", "y_", percent) & _may_link(percent))
        .select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"))
        .distinct()
        .join(tried.select("a", "b"), ["a", "b"], "left_anti")
    )
    links = tried.unionByName(space.stored(_verified(rest, sets, percent), "checked")).filter("linked")

    comps = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")
    rooted = members.filter("n > 0").join(comps, "cls", "left").select("id", "h", "n", F.coalesce("component", "cls").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(roots, "root").select("id", "h", "n", "component_id").unionByName(members.filter("n = 0").select("id", "h", "n", F.col("id").alias("component_id")))


def _common_tokens(profile: DataFrame):
    """The most common tokens and their levels, sorted by token, as a broadcast of bounded size."""
    counted = profile.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n"), F.max("a").alias("often")).filter(F.col("n") >= COMMON_LEAST)
    level = F.least(F.floor(F.log2("n")), F.lit(FREQUENT_LEVEL - 1)) + FREQUENT_LEVEL * F.col("often")
    common = counted.orderBy(F.desc("n"), "id").limit(COMMON_LIST).select("id", level.alias("level"))
    rows = [(r.id, r.level) for r in common.toLocalIterator()]
    token = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return profile.sparkSession.sparkContext.broadcast((token[order], np.array([r[1] for r in rows], np.uint8)[order]))


def _bounds(lists: DataFrame, percent: int) -> DataFrame:
    """Classes that may link, and the overlap (``eff``) that none of their pairs exceeds: a rare
    token of the prefix that no other class has cannot be shared."""
    counted = lists.groupBy("cls").agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.count_distinct(F.expr(f"if(place % 4 = {RARE}, place, null)")).alias("shared"))
    return counted.select("cls", (F.col("n") - F.col("rare") + F.col("shared")).cast("int").alias("eff"), "n").filter(F.expr(f"100 * eff >= {percent} * n")).drop("n")


def _shared_keys(posted: DataFrame) -> DataFrame:
    """The postings whose key has two classes or more: one exchange by key."""
    by_key = Window.partitionBy("key")
    return posted.withColumns({"lo": F.min("cls").over(by_key), "hi": F.max("cls").over(by_key)}).filter("lo < hi").select("key", "cls", "n", "rare", "place")
