"""Attributes mapped to the terms of a glossary, by their names.

A name's score for a term blends the cosine of TF-IDF vectors, the edit ratio
and the share of common words, in the shares that are left of the usual ones when
there are no word vectors. Pairs come from an inverted index of words and, for
misspelt names, from shared rare q-grams: a pair that neither gives stays below
FLOOR, so none is lost. Equal names are one name before anything is joined.

Optional knowledge beyond the name (meta, 0 to 1; null: none) raises a fair
score, or lowers one that it speaks against.

Edge cases: null and wordless names and terms are not mapped (their attributes have a null
term); repeated attributes get rows each; repeated terms are one; equal scores go by
the term's name; an empty glossary maps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import linkage
from plumbline.operators.records import ratio

#: Weights of TF-IDF, edit ratio and common words; from which ratio a name is the term itself, and its score.
WEIGHTS = (0.2, 0.3, 0.1)
DIRECT, DIRECT_SCORE, DIRECT_MORE, DIRECT_MOST = 95.0, 0.98, 0.1, 1.05
#: Least and most score; bounds of meta and what it does.
FLOOR, MOST = 0.4, 1.1
LOW, LOW_FACTOR, HIGH, HIGH_TEXT, HIGH_FACTOR = 0.4, 0.65, 0.85, 0.3, 0.4


def words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _vectors(names: DataFrame, idf: DataFrame) -> DataFrame:
    """(name, word, weight): TF-IDF of length 1."""
    counted = names.select("name", F.explode(words(F.col("name"))).alias("word")).groupBy("name", "word").agg(F.count("*").alias("tf"))
    weighted = counted.join(idf, "word").withColumn("weight", F.col("tf") * F.col("idf"))
    length = weighted.groupBy("name").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weighted.join(length, "name").select("name", "word", (F.col("weight") / F.col("length")).alias("weight"))


def cosines(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, term, cosine) of names and terms that share a word; documents of the TF-IDF are the names."""
    size = names.agg(F.count("*").alias("size"))
    df = names.select(F.explode(F.array_distinct(words(F.col("name")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("word", (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    a, b = _vectors(names, idf), _vectors(terms.select(F.col("term").alias("name")), idf).withColumnsRenamed({"name": "term", "weight": "other"})
    return a.join(b, "word").groupBy("name", "term").agg(F.sum(F.col("weight") * F.col("other")).alias("cosine"))


def _misspelt(names: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """(name, term) whose edit ratio may reach ``least``: they share a rare q-gram."""
    both = names.select(F.lower("name").alias("label"), "name", F.lit(0).alias("side")).unionByName(terms.select(F.lower("term").alias("label"), F.col("term").alias("name"), F.lit(1).alias("side")))
    both = both.withColumn("node", F.xxhash64("side", "name"))
    pairs = linkage.candidates(both.select("node", "label", "side"), [linkage.Field("label")], [("label",)], least, across=True)
    return pairs.join(both.select(F.col("node").alias("u"), "name"), "u").join(both.select(F.col("node").alias("v"), F.col("name").alias("term")), "v").select("name", "term")


def mapped(attributes: DataFrame, glossary: DataFrame, id_col: str, name_col: str, term_col: str, meta_col: str | None = None) -> DataFrame:
    """The best term of each attribute: id, name, term, score (six places), direct (the name is the term, nearly)."""
    rows = attributes.select(F.col(id_col).alias("id"), F.col(name_col).cast("string").alias("name"), (F.col(meta_col).cast("double") if meta_col else F.lit(None).cast("double")).alias("meta"))
    # equal names are one before words are looked for (the aggregate keeps the filter above it)
    filled = lambda df, c: df.groupBy(c).agg(F.max(c).alias("own")).filter(F.size(words(F.col("own"))) > 0).select(c)
    names, terms = filled(rows.select("name"), "name"), filled(glossary.select(F.col(term_col).cast("string").alias("term")), "term")
    near = cosines(names, terms)
    total = sum(WEIGHTS)
    # without a common word the edit ratio has to make up the floor by itself (or HIGH_TEXT, which meta may raise)
    least = 100 * (HIGH_TEXT if meta_col else FLOOR) * total / WEIGHTS[1]
    pairs = near.select("name", "term").unionByName(_misspelt(names, terms, least)).distinct().join(near, ["name", "term"], "left")
    edit = ratio(F.lower("name"), F.lower("term"))
    x, y = F.array_distinct(words(F.col("name"))), F.array_distinct(words(F.col("term")))
    common = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    scored = pairs.withColumn("edit", edit).withColumn("text", (WEIGHTS[0] * F.coalesce("cosine", F.lit(0.0)) + WEIGHTS[1] * F.col("edit") / 100 + WEIGHTS[2] * common) / total)
    # what meta does differs by attribute; text scores are of names
    each = rows.select("name", "meta").distinct().join(scored, "name")
    meta, text = F.col("meta"), F.col("text")
    blended = F.when((meta < LOW) & (text > 0.1), text * LOW_FACTOR).when((meta >= HIGH) & (text >= HIGH_TEXT), text * (1 + meta * HIGH_FACTOR)).otherwise(text)
    score = F.when(F.col("edit") >= DIRECT, F.least(DIRECT_SCORE + DIRECT_MORE * F.coalesce(meta, F.lit(0.0)), F.lit(DIRECT_MOST))).otherwise(F.least(blended, F.lit(MOST)))
    each = each.withColumn("score", F.round(score, 6)).withColumn("direct", F.col("edit") >= DIRECT).filter(F.col("score") >= FLOOR)
    best = Window.partitionBy("name", "meta").orderBy(F.desc("score"), "term")
    best = each.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("name", "meta", "term", "score", "direct")
    r, b = rows.alias("r"), best.alias("b")
    return r.join(b, F.expr("r.name = b.name and r.meta <=> b.meta"), "left").select("r.id", "r.name", "b.term", "b.score", "b.direct")
