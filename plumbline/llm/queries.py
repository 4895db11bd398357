"""The numbered queries of this subpackage: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import archives, bpe, collocations, contamination, extraction, fingerprints, jaccard, licenses, quality, ranked, substring, toxicity, url_lists
from plumbline.llm.shared import table


def vocabulary() -> str:
    """The vocabulary file of op1 (a public tokenizer's, installed with it)."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op5_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op6_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.over_pages(spark, sf_dir)


def op7_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.substring_dedup(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("lost_chars", "cleaned")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op11_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_chunk_reuse,
        op2_toxicity_weak_supervision,
        op3_license_scan,
        op4_html_extraction,
        op5_warc_from_arc,
        op6_url_temporal_lists,
        op7_substring_recompression,
        op8_quality_rules,
        op9_decontamination,
        op10_ngram_jaccard_join,
        op11_multiset_fingerprints,
        op12_phrase_collocations,
        op13_ranked_search,
    )
}
#: Where SQL is bearable on whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_url_temporal_lists": url_lists.ORACLE,
    "op9_decontamination": contamination.ORACLE,
    "op12_phrase_collocations": collocations.ORACLE,
    "op13_ranked_search": ranked.ORACLE,
}
