"""Pairs of similar records, links between two tables, and clusters that grow by increments.

Records are compared by fields, each of one or several types (the best one
counts) and a weight; the similarity of two records is the weighted mean.

Pairs come from an index instead of all pairs. For a mean of at least ``least``
every field has a least similarity of its own, whatever the others have
(``field_least``); where that is above 0, similar values share a token:

* ratio (ShortString): of the rarest q-grams of each value, as many as edits could
  destroy and two more, a pair (one of them and one more, where values are so long
  that there would be too many pairs, or so short that edits may leave one);
  partial ratio (String, Text): one of the rarest of
  the shorter value among all grams of the longer; Set: one of the rarest words;
  Exact, Categorical: the value; Price: the price in cents or its neighbour's.

A key names one field or several; records meet where they share a token of each
of its fields, so that a frequent value of one field is split by the others.
Every such key finds all pairs that reach ``least`` (fields whose own least
similarity is 0 can't be in a key). ``neighbours`` is for the other cases:
the following records in an order, a fixed number for each record.

Where a key holds all fields, some equal and some by ratio, records of equal ones
are compared in tiles instead (``tiles``): no tokens and no candidates are exchanged.

Equal records are one before anything is compared, so groups of copies give no
pairs. Edge cases: null and blank values count as empty ones, two empty ones
as alike (100), an empty and a filled one as 0; repeated and null ids get rows as often as they stand;
empty tables give no rows; columns that aren't named are not read. Long values
have many grams: use Set for texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import tiles
from plumbline.operators.components import connected_components
from plumbline.operators.records import kilometres, partial_ratio, ratio, token_set
from plumbline.sources.scratch import Workspace, stored

Q = 3
#: Up to how many rarest q-grams are taken by pairs.
PAIRED = 20
#: About how many records of a block meet each other in one group of a task.
TILE = 1_000
#: Blocks are compared in tiles where they have this many pairs on the mean, and records no more than that many partners.
WORTH, PARTNERS = 1_000, 1_000_000
_CENTS = 100


@dataclass(frozen=True)
class Field:
    """A compared column. ``agree``: the similarity from which two values agree, for links."""

    name: str
    kinds: tuple[str, ...] = ("ShortString",)
    weight: float = 1.0
    agree: float = 85.0


def text(column: Column) -> Column:
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def _by_kind(kind: str, a: Column, b: Column) -> Column:
    if kind in ("Exact", "Categorical"):
        return F.when(a == b, 100.0).otherwise(0.0)
    if kind == "ShortString":
        return ratio(a, b)
    if kind in ("String", "Text"):
        return partial_ratio(a, b)
    if kind == "Set":
        return token_set(a, b)
    if kind == "Price":
        return F.when(F.abs(a.try_cast("double") - b.try_cast("double")) < 0.01, 100.0).otherwise(0.0)
    if kind == "LatLong":
        (a1, a2), (b1, b2) = ((F.get(F.split(x, ","), i).try_cast("double") for i in (0, 1)) for x in (a, b))
        return F.when(kilometres(a1, a2, b1, b2) <= 1, 100.0).otherwise(0.0)
    raise ValueError(f"unknown type of field: {kind}")


def field_similarity(f: Field, a: Column, b: Column) -> Column:
    """0 to 100; two empty values are alike, an empty and a filled one are not."""
    x, y = text(a), text(b)
    best = F.greatest(*(_by_kind(k, x, y) for k in f.kinds), F.lit(0.0))
    return F.when((x == "") & (y == ""), 100.0).when((x == "") | (y == ""), 0.0).otherwise(best)


def similarity(fields: list[Field], a: str, b: str) -> Column:
    """The weighted mean of the fields' similarities of two aliased records."""
    return sum((f.weight * field_similarity(f, F.col(f"{a}.{f.name}"), F.col(f"{b}.{f.name}")) for f in fields), F.lit(0.0)) / sum(f.weight for f in fields)


def field_least(fields: list[Field], name: str, least: float) -> float:
    """What a field has to reach for the mean to reach ``least`` though all others have 100."""
    f = next(f for f in fields if f.name == name)
    return max(0.0, 100.0 - (100.0 - least) * sum(x.weight for x in fields) / f.weight)


# ---------------------------------------------------------------- candidates


def _grams(value: Column) -> Column:
    """A value's q-grams as hashes, told apart by how often they stood before."""
    n = F.length(value) - (Q - 1)
    plain = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(value, i, F.lit(Q)))).otherwise(F.array().cast("array<string>"))
    # equal ones stand together; the array is an argument, so that it is computed once
    numbered = F.transform(F.array(F.sort_array(plain)), lambda s: F.transform(s, lambda g, i: F.xxhash64(g, i.cast("long") + 1 - F.array_position(s, g))))
    return F.get(numbered, 0)


def _rare(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(True).alias("rare")))


def _own_tokens(value: Column, kind: str) -> Column | None:
    """Tokens (array of token and rare) that a value has by itself."""
    if kind in ("Exact", "Categorical"):
        return F.array(F.struct(F.xxhash64(value).alias("token"), F.lit(True).alias("rare")))
    if kind == "Price":
        cents = F.floor(value.try_cast("double") * _CENTS)
        # values less than a cent apart lie in one cent or in neighbouring ones
        both = F.array(*(F.struct((cents + k).alias("token"), F.lit(True).alias("rare")) for k in (0, 1)))
        return F.when(cents.isNotNull(), both).otherwise(F.array(F.struct(F.lit(-(1 << 62)).alias("token"), F.lit(True).alias("rare"))))
    return None


def _ranked(values: DataFrame, kind: str, share: float) -> DataFrame:
    """(value, need, all): a value's grams or words, the rarest first, and how many of them are to be looked up."""
    value = F.col("value")
    if kind == "Set":
        # of n words at least share * n are common: one stands among the n - ceil(share * n) + 1 rarest
        listed = values.withColumn("parts", F.transform(F.array_distinct(F.split(F.lower(value), " +")), lambda w: F.xxhash64(w)))
        listed = listed.withColumn("need", F.size("parts") - F.ceil(F.size("parts") * share - 1e-9).cast("int") + 1)
    else:
        longest = F.length(value) * (1.0 / share if kind == "ShortString" else 1.0)
        listed = values.withColumn("parts", _grams(value)).withColumn("need", Q * F.floor(longest * (1.0 - share) + 1e-9).cast("int") + 1)
    exploded = listed.select("value", "need", F.explode_outer("parts").alias("token"))
    counted = exploded.groupBy("token").agg(F.count("*").alias("n"))
    ranked = exploded.join(counted, "token", "left").groupBy("value", "need").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("n", "token")))).alias("all"))
    return ranked.select("value", "need", F.transform("all", lambda x: x.token).alias("all"))


def _tokens(values: DataFrame, kind: str, least: float) -> DataFrame:
    """(value, tokens: array of token and rare) of distinct values; only partial ratio has tokens that are not rare ones."""
    ranked = _ranked(values, kind, least / 100.0)
    # values with too few grams for the bound meet by a token of their own
    loose, zero = F.size("all") < F.col("need"), F.lit(0).cast("long")
    if kind in ("String", "Text"):
        # such a short value may lie within any longer one
        each = F.transform("all", lambda x, i: F.struct(x.alias("token"), (i < F.col("need")).alias("rare")))
        return ranked.select("value", F.concat(each, F.array(F.struct(zero.alias("token"), loose.alias("rare")))).alias("tokens"))
    return ranked.select("value", _rare(F.concat(F.slice("all", F.lit(1), F.col("need")), F.when(loose, F.array(zero)).otherwise(F.array().cast("array<bigint>")))).alias("tokens"))


def _of_kind(kind: str) -> Column:
    """A type's column of tokens, told apart from other types'."""
    return F.transform(kind, lambda x: F.struct(F.xxhash64(F.lit(kind), x.token).alias("token"), x.rare.alias("rare")))


def _edits(longest: Column, share: float) -> Column:
    return F.floor(longest * (1.0 - share) + 1e-9)


def _paired(signed: DataFrame, values: DataFrame, share: float, space: Workspace) -> DataFrame:
    """Rows of ``signed`` (with value) for each token: two grams that similar values share, under the edits that the longer of them allows.

    A value has tokens for the edits that its own length allows (rare) and for
    those that longer values' would; one of a pair has to be the longer one. Edits
    leave two common grams at least where one of the values has two more than
    they could destroy; other values have single grams too, or a token of their own.
    """
    ranked = _ranked(values, "ShortString", share)
    grams = space.stored(ranked.select("value", F.size("all").alias("n"), F.slice("all", F.lit(1), F.col("need") + 1).alias("grams")), "grams")
    length, zero, none = F.length("value"), F.array(F.lit(0).cast("long")), F.array().cast("array<bigint>")
    rest = [c for c in signed.columns if c != "value"]
    rows = signed.join(grams, "value").select("*", F.explode(F.sequence(_edits(length, share), _edits(length / share, share))).alias("k"))
    rows = rows.withColumn("left", F.col("n") - Q * F.col("k")).withColumn("rare", F.col("k") == _edits(length, share))
    held = F.slice("grams", F.lit(1), (Q * F.col("k") + 2).cast("int"))
    rows = rows.select(*rest, "k", "left", "rare", F.when(F.col("left") < 1, F.concat(held, zero)).otherwise(held).alias("held"))
    rows = rows.select("*", F.posexplode("held").alias("at", "x"))
    # a gram with 0 is a single one, 0 with 0 the value's own token
    single = F.when((F.col("left") == 1) | ((F.col("left") < 1) & (F.col("at") == F.size("held") - 1)), zero).otherwise(none)
    rows = rows.select(*rest, "k", "rare", "x", F.explode(F.concat(F.slice("held", F.col("at") + 2, F.size("held")), single)).alias("y"))
    return rows.select(*rest, F.struct(F.xxhash64("k", "x", "y").alias("token"), "rare").alias("own"))


def _signatures(records: DataFrame, fields: list[Field], key: tuple[str, ...], least: float, space: Workspace) -> DataFrame:
    """(node, token, rare): a token of each of the key's fields (any type's) as one hash, and a bit for each that is rare."""
    named = {f.name: f for f in fields}
    lows = {name: field_least(fields, name, least) for name in key}
    for name in key:
        if lows[name] <= 0 or "LatLong" in named[name].kinds:
            raise ValueError(f"{name} can't be in a key: whatever its values, records may reach the least mean")
    signed = records.select("node", *(["side"] if "side" in records.columns else []), *(text(F.col(name)).alias(f"v{bit}") for bit, name in enumerate(key)))
    for bit, name in enumerate(key):
        kinds, value = named[name].kinds, F.col(f"v{bit}")
        values = records.select(text(F.col(name)).alias("value")).distinct()
        signed = signed.withColumn("value", value).drop(f"v{bit}")
        share = lows[name] / 100.0
        if kinds == ("ShortString",) and (values.agg(F.max(Q * _edits(F.length("value") / share, share))).first()[0] or 0) < PAIRED:
            signed = _paired(signed, values, share, space)
        else:
            for kind in kinds:
                own = _own_tokens(F.col("value"), kind)
                signed = signed.withColumn(kind, own) if own is not None else signed.join(_tokens(values, kind, lows[name]).withColumnRenamed("tokens", kind), "value")
            rest = [c for c in signed.columns if c not in ("value", *kinds)]
            numbered = F.concat(*(_of_kind(kind) for kind in kinds))
            signed = signed.select(*rest, F.explode(F.col(kinds[0]) if len(kinds) == 1 else numbered).alias("own"))
        signed = signed.withColumnRenamed("own", f"x{bit}")
    bits = range(len(key))
    rare = sum((F.when(F.col(f"x{b}.rare"), 1 << b).otherwise(0) for b in bits), F.lit(0))
    return signed.select("node", *(["side"] if "side" in records.columns else []), F.xxhash64(*(f"x{b}.token" for b in bits)).alias("token"), rare.alias("rare"))


def candidates(records: DataFrame, fields: list[Field], keys: list[tuple[str, ...]], least: float, across: bool = False, space: Workspace | None = None) -> DataFrame:
    """Pairs (u, v) of nodes that share a token of a key, each once; u < v, or side 0 with side 1 where ``across``.

    ``records``: node and the fields; where ``across``, side (0 or 1) too. All
    records that hold a token meet each other: give a field with frequent values
    company in its key. Grams are kept in the workspace, or as ``stored`` keeps them.
    """
    space, pairs = space or Workspace(records.sparkSession), None
    for key in keys:
        signed = _signatures(records, fields, key, least, space)
        # of each field's two tokens one has to be among the rare ones of its value
        met = F.expr(f"a.token = b.token and (a.rare | b.rare) = {(1 << len(key)) - 1}")
        # where sides are linked each is a side of the join: a token that one of them holds often is no pair
        left, right, order = (signed.filter("side = 0"), signed.filter("side = 1"), F.lit(True)) if across else (signed, signed, F.expr("a.node < b.node"))
        found = left.alias("a").join(right.alias("b"), met & order).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def neighbours(records: DataFrame, order: list[str], following: int, parts: list[str]) -> DataFrame:
    """Pairs (u, v) of records that stand at most ``following`` apart in the order of their block.

    Sorted neighbourhood: rows times ``following`` pairs, however large a block
    is. ``parts`` name the block; choose it so that a block fits a task's sort.
    """
    at = Window.partitionBy(*parts).orderBy(*order, "node")
    ahead = F.array(*(F.lead("node", k).over(at) for k in range(1, following + 1)))
    pairs = records.select("node", ahead.alias("ahead")).select("node", F.explode("ahead").alias("other")).filter("other is not null and other <> node")
    return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def with_node(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Records' content as a 64-bit node: records that are equal in all fields are one."""
    return df.withColumn("node", F.xxhash64(*(F.coalesce(F.col(f.name).cast("string"), F.lit("\x00")) for f in fields)))


def scored_pairs(records: DataFrame, pairs: DataFrame, fields: list[Field], least: float) -> DataFrame:
    """(u, v, score) of those pairs whose mean similarity reaches ``least``."""
    names = [f.name for f in fields]
    left, right = (records.select(F.col("node").alias(x), F.struct(*names).alias(n)) for x, n in (("u", "a"), ("v", "b")))
    return _scored(pairs.join(left, "u").join(right, "v"), fields, least).select("u", "v", "score")


def _scored(pairs: DataFrame, fields: list[Field], least: float) -> DataFrame:
    """Pairs of records a and b with their score, where it reaches ``least``.

    Values too far apart for the field's own least similarity go first, by an edit distance that stops at its limit.
    """
    for f in fields:
        low = field_least(fields, f.name, least)
        if f.kinds == ("ShortString",) and low > 0:
            x, y = text(F.col(f"a.{f.name}")), text(F.col(f"b.{f.name}"))
            limit = _edits(F.greatest(F.length(x), F.length(y)), low / 100.0).cast("int")
            pairs = pairs.filter(F.call_function("levenshtein", x, y, limit) >= 0)
    return pairs.withColumn("score", similarity(fields, "a", "b")).filter(F.col("score") >= least)


def similar_records(df: DataFrame, fields: list[Field], keys: list[tuple[str, ...]], least: float = 90.0, space: Workspace | None = None, id_col: str | None = None) -> DataFrame:
    """All pairs of different records whose mean similarity reaches ``least``: u, v, score.

    Records are nodes (``with_node``), or the smallest ``id_col`` (a long) of
    their rows; records without one give no pairs then.
    """
    names, records = [f.name for f in fields], with_node(df, fields)
    if not id_col:
        return _similar(records.select("node", *names).dropDuplicates(["node"]), fields, keys, least, space)
    records = records.groupBy("node").agg(F.min(id_col).cast("long").alias("named"), F.first(F.struct(*names)).alias("r"))
    return _similar(records.filter("named is not null").select("node", "named", "r.*"), fields, keys, least, space).filter("u < v")


def _similar(records: DataFrame, fields: list[Field], keys: list[tuple[str, ...]], least: float, space: Workspace | None, spanning: bool = False) -> DataFrame:
    """(u, v, score) of similar records, of different sides where they have one, by what they are named where they have that.

    ``spanning``: for components; tiles leave out pairs that others already hold together.
    """
    across, named, found, by_tokens = "side" in records.columns, "named" in records.columns, [], []
    for key in keys:
        if equal := _tiled(records, fields, key, least):
            values = [f.name for f in fields if f.name not in equal]
            shares = [field_least(fields, n, least) / 100.0 for n in values]
            weights = [(f.weight, f.name in equal) for f in fields]
            # pairs come under their names, so that no join has to follow
            rows = records.withColumn("node", F.col("named")) if named else records
            found.append(tiles.compared(rows, [text(F.col(n)) for n in equal], {f"v{i}": text(F.col(n)) for i, n in enumerate(values)}, shares, weights, least, spanning))
        else:
            by_tokens.append(key)
    blocks = {k: _block(records, fields, k, least) for k in by_tokens if not across}
    others = [within_blocks(records, block, fields, least) for block in blocks.values() if block]
    if rest := [k for k in by_tokens if not blocks.get(k)]:
        others.append(scored_pairs(records, candidates(records, fields, rest, least, across, space), fields, least))
    if named:
        u, v = (records.select(F.col("node").alias(x), F.col("named").alias(n)) for x, n in (("u", "a"), ("v", "b")))
        others = [x.join(u, "u").join(v, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "score") for x in others]
    pairs = reduce(DataFrame.unionByName, [*found, *others])
    return pairs.distinct() if len(keys) > 1 else pairs


def _tiled(records: DataFrame, fields: list[Field], key: tuple[str, ...], least: float) -> list[str]:
    """The fields of equal values of a key that tiles can compare the records by, else none.

    The key has to hold all fields. Blocks of few pairs go by tokens, as a group
    costs more than they do; so do very large ones, where tiles are quadratic.
    """
    by_name = {f.name: f for f in fields}
    equal = [n for n in key if set(by_name[n].kinds) <= {"Exact", "Categorical"}]
    values = [n for n in key if by_name[n].kinds == ("ShortString",)]
    if not equal or not values or set(key) != set(by_name) or len(equal) + len(values) < len(key) or any(field_least(fields, n, least) <= 0 for n in key):
        return []
    n = F.col("count").cast("double")
    blocks = records.groupBy(*(text(F.col(n)).alias(n) for n in equal)).count().agg(F.sum(n * n), F.sum(n), F.count("*")).first()
    return equal if blocks[2] and blocks[0] >= 2 * WORTH * blocks[2] and blocks[0] <= PARTNERS * blocks[1] else []


def _block(records: DataFrame, fields: list[Field], key: tuple[str, ...], least: float) -> list[str]:
    """The fields of equal values of a key whose other fields' grams tell nothing apart, else none.

    Where edits may destroy over half of the grams of most values, the rarest ones
    that are to be looked up are nearly all, and records meet at each of those
    that they share: comparing those of equal other fields once is less.
    """
    by_name = {f.name: f for f in fields}
    equal = [n for n in key if set(by_name[n].kinds) <= {"Exact", "Categorical"}]
    grams = [n for n in key if by_name[n].kinds == ("ShortString",) and field_least(fields, n, least) > 0]
    if not equal or not grams or len(equal) + len(grams) < len(key) or any(field_least(fields, n, least) <= 0 for n in equal):
        return []
    weak = []
    for n in grams:
        share = field_least(fields, n, least) / 100.0
        length = F.length(text(F.col(n)))
        weak.append(F.avg((2 * Q * F.floor(length / share * (1.0 - share) + 1e-9) > length - (Q - 1)).cast("double")))
    return equal if all((x or 0) > 0.5 for x in records.agg(*weak).first()) else []


def within_blocks(records: DataFrame, block: list[str], fields: list[Field], least: float) -> DataFrame:
    """(u, v, score) of all pairs with equal ``block`` fields whose mean similarity reaches ``least``.

    Quadratic in a block, but no pair is kept before it is scored: a block is
    dealt over parts of about TILE records, and every two parts meet in a task's group.
    """
    names = [f.name for f in fields]
    rows = records.select("node", F.struct(*names).alias("r"), F.xxhash64(*(text(F.col(n)) for n in block)).alias("block"))
    parts = rows.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    rows = rows.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
    left = rows.select("node", "r", "block", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    right = rows.select("node", "r", "block", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    a, b = left.select("block", "i", "j", F.col("node").alias("u"), F.col("r").alias("a")), right.select("block", "i", "j", F.col("node").alias("v"), F.col("r").alias("b"))
    met = a.join(b.hint("shuffle_hash"), ["block", "i", "j"]).filter("i < j or u < v")
    return _scored(met, fields, least).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "score")


# ---------------------------------------------------------------- clusters, at once and by increments


def clusters(df: DataFrame, id_col: str, fields: list[Field], keys: list[tuple[str, ...]], least: float = 90.0) -> DataFrame:
    """Every row with its cluster: ``df``'s columns and cluster_id, the smallest id that similar records lead to.

    A cluster is a whole component of similar records; rows whose cluster has no
    id have a null one.
    """
    with Workspace(df.sparkSession) as space:
        records = with_node(df, fields).select("node", *(f.name for f in fields)).dropDuplicates(["node"])
        links = space.stored(_similar(records, fields, keys, least, space, spanning=True).select("u", "v"), "links")
        return _named(with_node(df, fields), connected_components(links), id_col)


def _named(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Rows (with node) under their component's smallest id."""
    joined = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = joined.groupBy("component").agg(F.min(id_col).alias("cluster_id"))
    return joined.join(names, "component").drop("component", "node")


def extended(state: DataFrame, new: DataFrame, id_col: str, fields: list[Field], keys: list[tuple[str, ...]], least: float = 90.0) -> DataFrame:
    """Clusters (the result of ``clusters`` or of this) with new rows, as ``clusters`` of all rows gives them.

    New records meet stored ones by the index only where one of the two is new;
    what is stored is not compared again: a cluster's records are held together
    by their cluster_id (rows without one count as new). Clusters that new
    records join get the smallest id of all. Rows that come again are rows again.
    """
    columns = [c for c in state.columns if c != "cluster_id"]
    with Workspace(state.sparkSession) as space:
        old = with_node(state.filter("cluster_id is not null"), fields)
        fresh = with_node(new.select(*columns).unionByName(state.filter("cluster_id is null").select(*columns)), fields)
        names = [f.name for f in fields]
        stays = old.select("node", *names).dropDuplicates(["node"]).withColumn("side", F.lit(0))
        comes = space.stored(fresh.select("node", *names).dropDuplicates(["node"]).join(stays.select("node"), "node", "left_anti").withColumn("side", F.lit(1)), "fresh")
        links = _similar(comes.drop("side"), fields, keys, least, space, spanning=True)
        links = links.unionByName(_similar(stays.unionByName(comes), fields, keys, least, space, spanning=True)).select("u", "v")
        # a stored cluster hangs together by an edge from its smallest record to each
        first = old.groupBy("cluster_id").agg(F.min("node").alias("u"))
        held = old.join(first, "cluster_id").select("u", F.col("node").alias("v")).filter("u <> v")
        labels = connected_components(space.stored(links.unionByName(held).distinct(), "links"))
        return _named(old.drop("cluster_id").unionByName(fresh), labels, id_col)


def representatives(state: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One record a cluster: cluster_id and each column of ``rules`` by its rule (see ``survivors``)."""
    return survivors(state.filter("cluster_id is not null"), "cluster_id", rules)


def similar_clusters(state: DataFrame, fields: list[Field], keys: list[tuple[str, ...]], rules: dict[str, str], least: float = 90.0) -> DataFrame:
    """Clusters whose representatives are similar: cluster_id, merged_id (the smallest id of the group); others are left out."""
    with Workspace(state.sparkSession) as space:
        reps = space.stored(representatives(state, rules), "representatives")
        records = with_node(reps, fields).select("node", *(f.name for f in fields)).dropDuplicates(["node"])
        labels = connected_components(space.stored(_similar(records, fields, keys, least, space, spanning=True).select("u", "v"), "pairs"))
        grouped = with_node(reps, fields).join(labels, "node", "left").withColumn("group", F.coalesce("component", "node"))
        names = grouped.groupBy("group").agg(F.min("cluster_id").alias("merged_id"), F.count("*").alias("n")).filter("n > 1")
        return stored(grouped.join(names, "group").select("cluster_id", "merged_id"), "similar")


def merged(state: DataFrame, similar: DataFrame) -> DataFrame:
    """The state with similar clusters under one id."""
    return state.join(similar, "cluster_id", "left").withColumn("cluster_id", F.coalesce("merged_id", "cluster_id")).drop("merged_id")


def merge_output(state: DataFrame, id_col: str, rules: dict[str, str]) -> DataFrame:
    """One row a cluster: cluster_id, n_records, merged (more than one record), and the survivor's columns.

    Records alone in their cluster keep their values as they are, as one of one
    value survives; totals follow by a sum over the rows.
    """
    size = state.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n_records"))
    return size.join(representatives(state, rules), "cluster_id").withColumn("merged", F.col("n_records") > 1)


#: Which values count, by rule; the expressions are fixed values.
_VALID = {"email": r"^[^@]+@[^@]+\.[^@]+$", "phone": r"^\+?[\d\s\-]{10,15}$"}


def survivors(df: DataFrame, by: str, rules: dict[str, str]) -> DataFrame:
    """Per group one value of each column, by its rule.

    ``email`` and ``phone``: the most frequent valid one, or else as ``value``;
    ``date``: the latest that is a date, or else as ``value``; ``value``: the most
    frequent, of equals the longest, then the smallest. Nulls and empty values
    don't count; a column without values is null. Values are counted before they
    are compared, so a large group is as many rows as it has different values.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(c).cast("string").alias("value")) for c, r in rules.items()))
    long = df.select(by, F.explode(cells).alias("x")).select(by, "x.*").filter("value is not null and value <> ''")
    counted = long.groupBy(by, "column", "rule", "value").agg(F.count("*").alias("n"))
    valid = F.lit(False)
    for rule, pattern in _VALID.items():
        valid = valid | ((F.col("rule") == rule) & F.trim("value").rlike(pattern))
    date = F.when(F.col("rule") == "date", F.col("value").try_cast("timestamp"))
    # the greatest of (valid, date, count, length) and the smallest value among equals
    rank = F.struct((valid | date.isNotNull()).alias("valid"), date.alias("date"), "n", F.length("value").alias("length"))
    best = counted.withColumn("rank", rank)
    top = best.groupBy(by, "column").agg(F.max("rank").alias("rank"))
    chosen = best.join(top, [by, "column", "rank"]).groupBy(by, "column").agg(F.min("value").alias("value"))
    wide = chosen.groupBy(by).pivot("column", list(rules)).agg(F.first("value"))
    return df.select(by).distinct().join(wide, by, "left")


# ---------------------------------------------------------------- links between two tables


@dataclass
class LinkModel:
    """Share of links among all pairs of a left and a right record; by field the probability to agree if linked (m) and if not (u)."""

    share: float
    m: list[float] = field(default_factory=list)
    u: list[float] = field(default_factory=list)

    def weight(self, agreed: Column, i: int) -> Column:
        """Evidence in bits: for agreement, against it, none where a value is missing."""
        return F.when(agreed, math.log2(self.m[i] / self.u[i])).when(~agreed, math.log2((1 - self.m[i]) / (1 - self.u[i]))).otherwise(0.0)


def agreements(records: DataFrame, pairs: DataFrame, fields: list[Field]) -> DataFrame:
    """(u, v, g0, g1, ...): whether each field agrees; null where a value is missing."""
    names = [f.name for f in fields]
    left, right = (records.select(F.col("node").alias(x), F.struct(*names).alias(n)) for x, n in (("u", "a"), ("v", "b")))
    joined = pairs.join(left, "u").join(right, "v")
    filled = [(text(F.col(f"a.{n}")) != "") & (text(F.col(f"b.{n}")) != "") for n in names]
    return joined.select("u", "v", *(F.when(filled[i], field_similarity(f, F.col(f"a.{f.name}"), F.col(f"b.{f.name}")) >= f.agree).alias(f"g{i}") for i, f in enumerate(fields)))


def patterns(agreed: DataFrame, n_fields: int) -> DataFrame:
    """How many pairs have each pattern of agreement: at most 3**fields rows."""
    return agreed.groupBy(*(f"g{i}" for i in range(n_fields))).agg(F.count("*").alias("n"))


def chance_pairs(records: DataFrame, each: int = 16) -> DataFrame:
    """Pairs of a left and a right record that only a hash brings together, about ``each`` for each record."""
    buckets = max(1, records.groupBy("side").count().agg(F.max("count")).first()[0] or 0) // each + 1
    dealt = records.select("node", "side", F.pmod(F.xxhash64("node", F.lit("chance")), F.lit(buckets)).alias("bucket"))
    return dealt.filter("side = 0").alias("a").join(dealt.filter("side = 1").alias("b"), "bucket").select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


Patterns = list[tuple[tuple[bool | None, ...], int]]


def fitted(counts: Patterns, by_chance: Patterns, all_pairs: int, rounds: int = 2000, settled: float = 1e-10) -> LinkModel:
    """Expectation maximisation over patterns of agreement, fields independent given whether a pair is linked.

    ``counts`` are the candidates' patterns, which m and the share of links come
    from; other pairs count as not linked. ``by_chance`` are those of pairs met by
    chance, which u comes from, less the links among them. No patterns give a
    model without links.
    """
    k = len((counts or by_chance or [((), 0)])[0][0])
    agree = lambda each, i: (sum(n for g, n in each if g[i]), sum(n for g, n in each if g[i] is not None))

    def split(found: Patterns, model: LinkModel) -> list[tuple[tuple, float]]:
        """Each pattern's expected links."""
        each = []
        for g, n in found:
            linked, other = model.share, 1 - model.share
            for i, x in enumerate(g):
                if x is not None:
                    linked *= model.m[i] if x else 1 - model.m[i]
                    other *= model.u[i] if x else 1 - model.u[i]
            each.append((g, n * linked / (linked + other)))
        return each

    start = [(a + 0.5) / (n + 1.0) for a, n in (agree(by_chance, i) for i in range(k))]
    model = LinkModel(sum(n for _, n in counts) / max(1, all_pairs) / 2, [0.9] * k, start)
    for _ in range(rounds if counts else 0):
        linked = split(counts, model)
        others = [(g, n - p) for (g, n), (_, p) in zip(by_chance, split(by_chance, model), strict=True)]
        m = [min(max((a + 1e-6) / (n + 2e-6), 1e-6), 1 - 1e-6) for a, n in (agree(linked, i) for i in range(k))]
        u = [min(max((a + 0.5) / (n + 1.0), 1e-9), 1 - 1e-6) for a, n in (agree(others, i) for i in range(k))]
        after = LinkModel(min(max(sum(p for _, p in linked) / max(1, all_pairs), 1e-18), 1 - 1e-9), m, u)
        moved = max(abs(x - y) for x, y in zip([model.share, *model.m, *model.u], [after.share, *m, *u], strict=True))
        model = after
        if moved < settled:
            break
    return model


def one_to_one(pairs: DataFrame, space: Workspace, max_rounds: int = 200) -> DataFrame:
    """Of (u, v, score) the pairs taken greedily from the highest score on, each u and each v once.

    Rounds: pairs that are the best of both their ends are taken and all other
    pairs of these ends go; equal scores go by u, then v. The result is that of
    taking pairs one by one in order. Only counts come to the driver.
    """
    order = F.struct("score", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))
    open_ = space.stored(pairs.select("u", "v", order.alias("rank")), "open0")
    taken = None
    for turn in range(max_rounds):
        best_u, best_v = (open_.groupBy(x).agg(F.max("rank").alias("rank")) for x in ("u", "v"))
        both = open_.join(best_u, ["u", "rank"], "left_semi").join(best_v, ["v", "rank"], "left_semi")
        found = stored(both, "links")
        taken = found if taken is None else taken.unionByName(found)
        left = open_.join(found.select("u"), "u", "left_anti").join(found.select("v"), "v", "left_anti")
        open_ = space.stored(left, f"open{turn + 1}")
        space.free(f"open{turn}")
        if open_.isEmpty():
            return taken.select("u", "v", F.col("rank.score").alias("score"))
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def link_records(left: DataFrame, right: DataFrame, left_id: str, right_id: str, names: list[str]) -> DataFrame:
    """Both tables as records: node (2 * id + side), side, and the fields. Ids that are null or stand twice in a table are left out."""

    def once(df: DataFrame, id_col: str, side: int) -> DataFrame:
        single = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"), F.first(F.struct(*names)).alias("r"))
        return single.filter("n = 1").select((2 * F.col("id") + side).alias("node"), F.lit(side).alias("side"), "r.*")

    return once(left, left_id, 0).unionByName(once(right, right_id, 1))


def link_candidates(records: DataFrame, keys: list[tuple[Field, ...]], least: float) -> DataFrame:
    """Pairs (u of side 0, v of side 1) that share a token of a key, each of whose fields is held to ``least`` by itself."""
    pairs = None
    for key in keys:
        # with k fields of equal weight a mean of 100 - (100 - least) / k leaves each at ``least``
        held = [Field(f.name, f.kinds) for f in key]
        found = candidates(records, held, [tuple(f.name for f in held)], 100.0 - (100.0 - least) / len(held), across=True)
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def link(left: DataFrame, right: DataFrame, left_id: str, right_id: str, fields: list[Field], keys: list[tuple[Field, ...]], least: float = 90.0, probability: float = 0.5) -> tuple[DataFrame, LinkModel]:
    """Links between two tables whose fields have equal names: (left id, right id, score in bits), and the model.

    Candidates share a token of one of the keys (their types are the keys' own).
    How often fields agree by chance comes from hashed pairs, how often they do
    in links from the candidates' patterns; the driver gets patterns only. Links
    of at least the given probability are assigned one to one. Ids have to be longs
    below 2**62; rows whose id is null or stands twice in its table get no link.
    """
    with Workspace(left.sparkSession) as space:
        records = space.stored(link_records(left, right, left_id, right_id, [f.name for f in fields]), "records")
        agreed = space.stored(agreements(records, link_candidates(records, keys, least), fields), "agreed")
        k = len(fields)
        listed = lambda df: sorted(((tuple(r[f"g{i}"] for i in range(k)), r.n) for r in patterns(df, k).collect()), key=str)
        counts, sides = listed(agreed), {r.side: r["count"] for r in records.groupBy("side").count().collect()}
        by_chance = listed(agreements(records, chance_pairs(records), fields))
        model = fitted(counts, by_chance, sides.get(0, 0) * sides.get(1, 0))
        if not counts:
            return left.sparkSession.createDataFrame([], f"{left_id} long, {right_id} long, score double"), model
        bits = sum((model.weight(F.col(f"g{i}"), i) for i in range(len(fields))), F.lit(0.0))
        floor = math.log2(probability / (1 - probability)) - math.log2(model.share / (1 - model.share))
        links = one_to_one(agreed.select("u", "v", F.round(bits, 6).alias("score")).filter(F.col("score") >= floor), space)
        return links.select(F.expr("u div 2").alias(left_id), F.expr("(v - 1) div 2").alias(right_id), "score"), model
