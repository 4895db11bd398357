"""Document fingerprints: a homomorphic multiset hash (DataFrame functions only).

A text is the multiset of its paragraphs (\\n-split). Each paragraph is hashed to
a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors,
lane by lane modulo powers of two. So it doesn't depend on the paragraphs'
order, and paragraphs are inserted or deleted by adding or subtracting their
vectors (``inserted``, ``deleted``), without the rest of the text.

Lanes of a paragraph's vector:

* EXACT lanes modulo 2**32 from 64-bit hashes of the whole paragraph. Equal
  multisets of paragraphs have equal fingerprints, different ones differ but for
  collisions of EXACT * 32 bits;
* one lane that counts word pairs (a word and the one before it in the
  paragraph; the first has none before it), modulo 2**32;
* SKETCH lanes modulo 2**16: how many of these pairs have a one in the lane's bit
  of their hash. Less half of the count, a lane is a random projection of the
  counts of pairs, and ``likeness`` is 2 a.b / (a.a + b.b) of two texts' counts
  as the lanes estimate it, held within 0 and 1 (equal fingerprints: 1). Its
  standard error is about 1 / sqrt(SKETCH).

``with_edited`` cuts each text at half, lets the beginning of the next document
follow, and gives both fingerprints: the paragraphs before the cut are hashed
once, those behind it are deleted, the new ones inserted.

Words are exploded and summed within the task that holds the text; what is
exchanged are texts by document, and of each one only what its predecessor
takes. The order of documents comes from a range partition of ids alone; of
each partition the last id comes to the driver.

Edge cases: null texts count as empty ones (one empty paragraph); equal rows
have equal results, and different texts of one id are documents each, in the
order of their hashes; documents without an id come last; the last one's next is
the first, the only one's is itself; an empty table gives no rows; columns other
than id and text are not read. Very long texts are read whole, as rows of
words; counts of pairs within one text have to stay below 2**32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import required, stored
from plumbline.sources.scratch import Workspace

EXACT, SKETCH = 8, 128
SPACE = r"[\x20\x09-\x0D]+"
#: Sums of one vector: exact halves of hashes, the count, and two lanes of 32 bits in each of the rest.
_PACKED = EXACT + 1 + SKETCH // 2
_LOW, _TWO = 0xFFFFFFFF, 0x0000000100000001


def _sums() -> list[Column]:
    """A vector's sums over rows (paragraph, pos, pair): whole paragraphs count at their first word."""
    exact = []
    for j in range(EXACT // 2):
        exact += [F.shiftrightunsigned(F.col(f"whole{j}"), 32), F.col(f"whole{j}").bitwiseAND(F.lit(_LOW))]
    lanes = [F.shiftrightunsigned(F.col(f"pair{k}"), s).bitwiseAND(F.lit(_TWO)) for k in range(SKETCH // 64) for s in range(32)]
    return [F.sum(c).alias(f"s{i}") for i, c in enumerate([*(F.when(F.col("pos") == 0, c).otherwise(0) for c in exact), F.lit(1).cast("long"), *lanes])]


def vectors(texts: DataFrame, keys: list[str], paragraphs: str = "paragraphs") -> DataFrame:
    """The sum of paragraphs' vectors by ``keys``: keys, vector (packed sums). Rows without paragraphs give none."""
    rows = texts.select(*keys, F.explode(paragraphs).alias("paragraph")).select(*keys, "paragraph", F.split("paragraph", SPACE).alias("words"))
    rows = rows.select(*keys, *(F.xxhash64("paragraph", F.lit(j)).alias(f"whole{j}") for j in range(EXACT // 2)), "words", F.posexplode("words").alias("pos", "word"))
    rows = rows.withColumn("pair0", F.xxhash64("word", F.when(F.col("pos") > 0, F.get("words", F.col("pos") - 1))))
    for k in range(1, SKETCH // 64):
        rows = rows.withColumn(f"pair{k}", F.xxhash64("pair0", F.lit(k)))
    return rows.groupBy(*keys).agg(*_sums()).select(*keys, F.array(*(f"s{i}" for i in range(_PACKED))).alias("vector"))


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def _kept_below_powers(vector: Column) -> Column:
    """Sums modulo 2**32 in each lane (packed ones lane by lane)."""
    two = F.lit(_LOW)
    return F.transform(
        vector,
        lambda x, i: F.when(i <= EXACT, x.bitwiseAND(two)).otherwise(x),
    )


def inserted(vector: Column, more: Column) -> Column:
    """The fingerprint's vector with the paragraphs of ``more`` added (lanes have room for one text's counts)."""
    return _kept_below_powers(F.zip_with(vector, more, lambda a, b: a + b))


def deleted(vector: Column, less: Column) -> Column:
    """The fingerprint's vector without the paragraphs of ``less``, which it has to hold."""
    return _kept_below_powers(F.zip_with(vector, less, lambda a, b: a - b))


def empty() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), _PACKED)


def _lanes(vector: Column) -> Column:
    """The sketch lanes, unpacked."""
    return F.flatten(F.transform(F.slice(vector, EXACT + 2, SKETCH // 2), lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW)))))


def fingerprint(vector: Column) -> Column:
    """Hexadecimal: exact lanes and the count (8 digits each), sketch lanes modulo 2**16 (4 digits each)."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    wide = F.transform(F.slice(vector, 1, EXACT + 1), lambda x: digits(x.bitwiseAND(F.lit(_LOW)), 8))
    return F.concat(F.array_join(wide, ""), F.array_join(F.transform(_lanes(vector), lambda x: digits(x.bitwiseAND(F.lit(0xFFFF)), 4)), ""))


def projections(vector: Column) -> Column:
    """Lanes as sums of plus and minus one."""
    n = F.element_at(vector, EXACT + 1)
    return F.transform(_lanes(vector), lambda x: (2 * x - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from the projections of two fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    both = dot(a, a) + dot(b, b)
    return F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / both)))


def _with_previous(keys: DataFrame, space: Workspace) -> DataFrame:
    """Each document (k, h) with the one before it: k, h, id, prev_k, prev_h, prev_chars."""
    spark = keys.sparkSession
    order = [F.col("id").isNull(), F.col("id"), F.col("h")]
    dealt = space.stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    whole = lambda: F.struct(F.col("id").isNull().alias("none"), "id", "h", "k", "n_chars")
    lasts = sorted(dealt.groupBy("part").agg(F.max(whole()).alias("last")).collect())
    before = [(r.part, lasts[i - 1].last.k, lasts[i - 1].last.h, lasts[i - 1].last.n_chars) for i, r in enumerate(lasts)]
    edge = spark.createDataFrame(before, "part int, edge_k long, edge_h long, edge_chars long")
    at = Window.partitionBy("part").orderBy(*order)
    dealt = dealt.withColumns({f"lag_{c}": F.lag(c).over(at) for c in ("k", "h", "n_chars")})
    dealt = dealt.join(F.broadcast(edge), "part")  # a row a partition
    taken = {"prev_k": ("lag_k", "edge_k"), "prev_h": ("lag_h", "edge_h"), "prev_chars": ("lag_n_chars", "edge_chars")}
    return dealt.select("k", "h", "id", *(F.coalesce(*c).alias(n) for n, c in taken.items()))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    texts = required(docs, **{id_col: "long", text_col: "string"}).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumns({"k": F.coalesce("id", F.lit(0)), "h": F.xxhash64("text", F.col("id").isNull())})
    with Workspace(docs.sparkSession) as space:
        found = stored(_edited(texts, space), "vectors")
        space.drop_shuffles()
        after = found.select(F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.col("own").alias("after"))
        done = found.join(after, ["k", "h"]).withColumns({f"{c}_p": projections(F.col(c)) for c in ("own", "edited", "after")})
        done = done.select(
            "k", "h", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own_p"), F.col("edited_p")).alias("near_edited"), likeness(F.col("own_p"), F.col("after_p")).alias("near_next"),
        )
        return texts.select("id", "k", "h").join(done, ["k", "h"]).drop("k", "h").withColumnRenamed("id", id_col)


def _edited(texts: DataFrame, space: Workspace) -> DataFrame:
    """Documents told apart by (k, h): n_chars, edited_sha256, vectors own and edited, and the document before."""
    keys = texts.groupBy("k", "h").agg(F.max("id").alias("id"), F.max(F.length("text").cast("long")).alias("n_chars"))
    previous = space.stored(_with_previous(keys, space), "previous")
    once = texts.groupBy("k", "h").agg(F.first("text").alias("text"))
    begun = once.join(previous, ["k", "h"]).select(F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.expr("left(text, cast(prev_chars div 2 as int))").alias("following"))
    both = once.join(begun, ["k", "h"]).join(previous.select("k", "h", "prev_k", "prev_h"), ["k", "h"]).withColumn("n", F.length("text"))
    both = both.withColumn("kept", F.expr("left(text, n - n div 2)"))
    # the paragraph that the cut divides begins behind the last line end that stays
    both = both.withColumn("divided", F.substring_index("kept", "\n", -1)).withColumn("whole", F.length("kept") - F.length("divided"))
    both = both.withColumn("edited", F.concat("kept", "following"))
    kept = ["k", "h", "prev_k", "prev_h", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    parts = F.array(
        F.when(F.col("whole") > 0, F.struct(F.lit(0).alias("part"), paragraphs(F.expr("left(kept, whole - 1)")).alias("paragraphs"))),
        F.struct(F.lit(1).alias("part"), paragraphs(F.expr("substring(text, whole + 1)")).alias("paragraphs")),
        F.struct(F.lit(2).alias("part"), paragraphs(F.expr("substring(edited, whole + 1)")).alias("paragraphs")),
    )
    rows = both.select(*kept, F.explode(parts).alias("p")).filter("p is not null")
    names = ["k", "h", "prev_k", "prev_h", "n_chars", "edited_sha256"]
    summed = vectors(rows.select(*names, F.col("p.part").alias("part"), F.col("p.paragraphs").alias("paragraphs")), [*names, "part"])
    each = summed.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("part", "vector"))).alias("v"))
    shared = F.coalesce(F.element_at("v", F.lit(0)), empty())
    own = inserted(shared, F.element_at("v", F.lit(1)))
    each = each.withColumn("own", own)
    return each.select(*names, "own", inserted(deleted(F.col("own"), F.element_at("v", F.lit(1))), F.element_at("v", F.lit(2))).alias("edited"))
