"""Cleaning a corpus for training: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All but the last keep the
columns of documents. Decisions hold for rows, told apart by id and text, so
that null and repeated ids and equal texts are judged each; an empty table
stays empty; null texts count as empty ones; extra columns are kept.

An operator frees its own stages when it returns; ``run`` frees a stage's
output when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, contamination, jaccard, substring, toxicity
from plumbline.llm.queries import vocabulary
from plumbline.llm.shared import hash_of_text, stored, table
from plumbline.sources.scratch import Workspace


def _rows(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with a decision on rows (doc_id, text_hash), null ids included; ``docs``'s columns."""
    keyed = docs.withColumn("_hash", hash_of_text("text")).alias("d")
    return keyed.join(decided.alias("x"), F.expr("d.doc_id <=> x.doc_id and d._hash = x.text_hash"), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    gone = toxicity.toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select("doc_id", "text_hash").distinct()
    return _rows(docs, gone, "left_anti").select(*(f"d.`{c}`" for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (all rows of that
    id, should it have several); documents without an id stay where none of their group has one."""
    groups = jaccard.ngram_jaccard_join(docs)
    stays = groups.filter("doc_id = component_id or component_id is null").select("doc_id", "text_hash").distinct()
    return _rows(docs, stays, "left_semi").select(*(f"d.`{c}`" for c in docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; documents that lose nothing keep their text as it is, those that lose all of it go."""
    cut = substring.substring_dedup(docs).filter("n_removed > 0").select("doc_id", "text_hash", "n_words", "n_removed", "kept").dropDuplicates(["doc_id", "text_hash"])
    changed = F.col("x.n_removed").isNotNull()
    columns = {"text": F.when(changed, F.col("x.kept")).otherwise(F.col("d.text")), "n_chars": F.when(changed, F.length("x.kept").cast("long")).otherwise(F.col("d.n_chars"))}
    both = _rows(docs, cut, "left").filter("x.n_removed is null or x.n_removed < x.n_words")
    return both.select(*(columns.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    gone = contamination.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "text_hash").distinct()
    return _rows(docs, gone, "left_anti").select(*(f"d.`{c}`" for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.bpe_round_trip(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_round_trip", encode),
]
#: SQL can't express the classifier or the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark) as space:
        for name, stage in STAGES[:-1]:
            docs = space.stored(stage(spark, docs, sf_dir), name)
            space.free(*(n for n, _ in STAGES if n != name))
        return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
